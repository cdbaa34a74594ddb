"""The ten operators against brute force, round trips and held-out accuracy, with the odd rows."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, keep_id int"
ODD = [None, "", "  \n ", "a", "one two three", "x " * 500, "Same text here.\nSame text here.", "Same text here.\nSame text here."]


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 1.0, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_texts(seed, n=60):
    """Random texts with exact copies, one-word edits, shared passages, repeated lines."""
    rng, out = random.Random(seed), list(ODD)
    passage = prose(rng, 40, 1000)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or len(out) < 10:
            out.append("\n".join(prose(rng, rng.randrange(1, 30), 400) for _ in range(rng.randrange(1, 6))))
        elif kind < 0.5:
            out.append(rng.choice(out))
        elif kind < 0.8:
            words = (rng.choice(out) or "").split(" ")
            words[rng.randrange(len(words))] = rng.choice(["edited", "edited twice", ""])
            out.append(" ".join(words))
        else:
            out.append(prose(rng, 15) + " " + passage + " " + prose(rng, 15))
    return out


def components(n, linked):
    up = list(range(n))
    for _ in range(n):
        changed = False
        for a, b in linked:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
        if not changed:
            break
    return up


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    from corpusloom.llm.exact import exact_dedup

    texts = near_texts(seed)
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, texts), per_shard=5, per_task=7).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), max(g) == i)
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup(frame(spark, texts).limit(0)).count() == 0


def test_exact_with_history(spark):
    """What history knows goes, whatever its ids; strangers are grouped by themselves; sizes count both."""
    from corpusloom.llm.exact import exact_dedup, known_digests

    history = known_digests(frame(spark, ["old", "old", "never again", None]))
    rows = exact_dedup(frame(spark, ["new", "old", "new", "", "old", "long " * 100_000]), history, per_shard=2, per_task=2).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [
        (0, 2, 2, False), (1, 1, 4, False), (2, 2, 2, True), (3, 3, 2, False), (4, 1, 4, False), (5, 5, 1, True)
    ]
    none = exact_dedup(frame(spark, ["a", "a"]), history.limit(0)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in none) == [(0, 1, False), (1, 1, True)]


def test_exact_of_repeated_and_missing_ids(spark):
    from corpusloom.llm.exact import exact_dedup

    got = exact_dedup(clashing(spark, REPEATED)).collect()
    assert len(got) == len(REPEATED)
    assert sorted((r["doc_id"] or 99, r["keep_id"] or 99, r["group_size"], r["kept"]) for r in got) == [
        (1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True), (2, 99, 2, False), (7, 99, 2, False), (8, 8, 1, True),
        (99, 99, 1, True), (99, 99, 2, True), (99, 99, 2, True),
    ]


def test_minimal_perfect_hash():
    import pandas as pd
    from corpusloom.llm.exact import SLOT, build_table, look_up

    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    seeds, slots = build_table(keys, pd.DataFrame({"row": np.arange(3000), "id": np.arange(3000) + 7, "copies": np.ones(3000, dtype=int)}))
    at, table = look_up(keys, seeds, slots)
    assert sorted(at) == list(range(3000)) and len(slots) == 3000 * SLOT.itemsize
    assert (table["row"][at] == np.arange(3000)).all() and (table["id"][at] == np.arange(3000) + 7).all()
    assert (look_up([hashlib.sha256(b"other%d" % i).digest() for i in range(500)], seeds, slots)[0] == -1).all()


def test_mixing(spark):
    from corpusloom.llm.mixing import mix, mixed_documents

    rng = random.Random(3)
    texts = near_texts(4)
    sources = [rng.choice(["b", "a", None, "c", "tiny"]) for _ in texts]
    docs = frame(spark, texts, sources)
    rows = mix(docs, range_rows=4).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mix(docs.repartition(7)).collect()}
    total = sum(r["size"] for r in rows)
    by, spare = {}, {}
    for r in rows:
        s = sources[r["doc_id"]]
        by.setdefault(s, [0, r["target"], r["source_size"]])[0] += r["taken"]
        spare[s] = r["target"]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
    assert sum(spare.values()) == pytest.approx(total)
    for taken, target, size in by.values():
        assert taken == int(target) and target <= 3 * size + 1e-6
    order = sorted(by, key=lambda s: (s is None, s))
    free = {s: by[s][1] / (i % 3 + 1) for i, s in enumerate(order) if by[s][1] < 3 * by[s][2]}
    assert max(free.values()) == pytest.approx(min(free.values()))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
        assert r["n_chars"] == len(r["text"] or "")
    assert all(words[r["doc_id"]] == r["taken"] for r in rows)
    assert mix(docs.limit(0)).count() == 0


def test_mixing_of_repeated_and_missing_ids(spark):
    from corpusloom.llm.mixing import mix, mixed_documents

    docs = clashing(spark, REPEATED)
    counts = mix(docs).collect()
    assert len(counts) == len(REPEATED) and sum(r["doc_id"] is None for r in counts) == 3
    mixed = mixed_documents(docs)
    assert mixed.schema == docs.schema
    out = mixed.collect()
    words = lambda rows: sum(len(WORD.findall(r["text"] or "")) for r in rows)
    assert words(out) == sum(r["taken"] for r in counts) and all(r["n_chars"] == len(r["text"] or "") for r in out)
    for r in counts:  # three equal rows stay three documents
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert mixed_documents(docs.limit(0)).count() == 0
    three = mixed_documents(clashing(spark, [(1, "a b c", "s")] * 3))
    assert [r["text"] for r in three.collect()] == ["a b c"] * 3


def test_mixing_without_words(spark):
    from corpusloom.llm.mixing import mix

    assert [r["taken"] for r in mix(frame(spark, [None, "", " "])).collect()] == [0, 0, 0]


@pytest.mark.parametrize("seed", [5, 6])
def test_simhash(spark, seed):
    import xxhash
    from corpusloom.llm.simhash import simhash_dedup, simhash_groups

    texts = near_texts(seed) + ["A b C d"]
    prints = []
    for t in texts:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = components(len(texts), links)
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(docs).collect()}
    assert got == {i: (f"{p:016x}", expected[i]) for i, p in enumerate(prints)}
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(expected)
    assert simhash_groups(docs.limit(0)).count() == 0


def test_simhash_links_in_dense_and_sparse_keys():
    from corpusloom.llm.simhash import SEGMENTS, group_edges

    rng = random.Random(0)
    for trial in range(20):
        base = rng.getrandbits(64)
        values = list({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(40)} | {rng.getrandbits(64) for _ in range(10)})
        keys = defaultdict(list)
        for i, v in enumerate(values):
            for bit in range(64):
                low, width = next((a, w) for a, w in SEGMENTS if a <= bit < a + w)
                keys[bit, (v >> low) & ((1 << width) - 1) & ~(1 << (bit - low))].append(i)
        edges = []
        for (bit, _), members in keys.items():
            found = group_edges(bit, np.array([values[i] for i in members], dtype=np.uint64), 4)
            edges += [(members[a], members[b]) for a, b in found]
        wanted = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4]
        assert components(len(values), edges) == components(len(values), wanted)


def brute_windows(texts, window=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_substring(spark, seed):
    from corpusloom.llm.spans import substring_dedup

    rng = random.Random(seed)
    texts = near_texts(seed) + ["a b " * 60, "b a " * 40, "c " * 19, "c " * 20, "c " * 21, prose(rng, 3000, 3), "long" * 400_000 + " end"]
    # a frequent phrase in ever new surroundings: its minimizer is cut again, down to windows
    phrase = prose(rng, 10, 3)
    texts += [f"{prose(rng, 25, 900)} {phrase} {prose(rng, 25, 900)}" for _ in range(30)]
    for per_shard in (200_000, 400):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(frame(spark, texts), per_shard=per_shard).collect()}
        assert got == brute_windows(texts)
    assert substring_dedup(frame(spark, texts).limit(0)).count() == 0


def test_substrings_of_repeated_and_missing_ids(spark):
    from corpusloom.llm.spans import substring_dedup

    long = prose(random.Random(0), 40, 900)
    rows = [*REPEATED, (3, long, "a"), (3, long, "a"), (None, long, "a"), (4, "x " + long + " y", "b"), (4, "z", "b")]
    got = substring_dedup(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got if r["n_removed"] or r["doc_id"] == 3) == [(3, 0), (3, 40), (4, 40), (8, 24), (99, 40)]


def test_suffix_automaton():
    from corpusloom.llm.spans import repeated_windows

    rng = random.Random(1)
    for _ in range(50):
        rows = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(6)]
        seen, expected = set(), []
        for r in rows:
            starts = []
            for s in range(len(r) - 3):
                key = tuple(r[s : s + 4])
                if key in seen:
                    starts.append(s)
                seen.add(key)
            expected.append(starts)
        assert repeated_windows(rows, 4) == expected


def brute_lines(texts):
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    earlier, out = [], {}
    for i, t in enumerate(texts):
        out[i] = []
        for n, line in enumerate((t or "").split("\n")):
            words = WORD.findall(line)
            if words:
                if any(near(words, e) for e in earlier):
                    out[i].append(n)
                earlier.append(words)
    return out


@pytest.mark.parametrize("seed", [10, 11])
def test_lines(spark, seed):
    """Many members of one key, lines that repeat inside a document, lines one and two edits apart."""
    from corpusloom.llm.lines import dedup_lines, line_report

    rng = random.Random(seed)
    texts = near_texts(seed) + ["t1 t2 t3 t4 t%d t6" % i for i in range(30)] + ["\n".join(prose(rng, 6, 2) for _ in range(20)), "a b c d", "a b x d"]
    docs = frame(spark, texts)
    expected = brute_lines(texts)
    assert {r["doc_id"]: r["removed"] for r in line_report(docs).collect()} == expected
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        t = texts[r["doc_id"]]
        gone = set(expected[r["doc_id"]])
        assert r["text"] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
        assert r["n_chars"] == len(r["text"] or "")
    assert line_report(docs.limit(0)).count() == 0


def test_long_lines(spark):
    """Keys of 20,000-word lines come from running ones: each word put in, left out or exchanged is found."""
    from corpusloom.llm.lines import line_report

    words = prose(random.Random(3), 20_000, 5000).split()
    texts = [" ".join(words), " ".join(words[:7000] + words[7001:]), " ".join(["new", *words]), " ".join([*words[:-1], "new"]), " ".join([*words[:5], "x", *words[6:9], "y", *words[10:]])]
    assert [r["removed"] for r in line_report(frame(spark, texts)).orderBy("doc_id").collect()] == [[], [0], [0], [0], []]


CLASH = "doc_id long, text string, source string, n_chars long, row string, doc string, norm int, line_no int, gone int, keep int, size int, taken int, words int, _id int, _size int, _taken int, _words int, _gone int, _keep int, fp int, rep int, node int"


def clashing(spark, rows):
    """Rows of (doc_id, text, source) in a table with the names that operators might use."""
    return spark.createDataFrame([(i, t, s, len(t or ""), "r", "d", *[5] * 16) for i, t, s in rows], CLASH)


REPEATED = [
    (1, "same words in this line here", "a"), (1, "same words in this line here", "a"), (1, "same words in this line here", "a"),
    (2, "another text\nsame words in this line here", "a"), (2, "gamma only here", "b"), (None, "no id at all", "b"), (None, "gamma only here", None),
    (None, None, None), (7, "", "a"), (8, "unlike all others " * 9, "b"),
]


def test_lines_of_repeated_and_missing_ids(spark):
    from corpusloom.llm.lines import dedup_lines, line_report

    docs = clashing(spark, REPEATED)
    out = dedup_lines(docs)
    assert out.schema == docs.schema
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["row"]) for r in out.collect())
    assert [(None if none else i, t) for none, i, t, _ in texts] == [
        (1, ""), (1, ""), (1, "same words in this line here"), (2, "another text"), (2, "gamma only here"), (7, ""), (8, "unlike all others " * 9), (None, ""), (None, ""), (None, "no id at all")
    ]
    assert sum(r["n_removed"] for r in line_report(docs).collect()) == 4


def test_pieces(spark):
    import sentencepiece
    from corpusloom.llm.pieces import decode_documents, default_model, encode_documents

    rng = random.Random(2)
    texts = near_texts(12, 30) + ["".join(rng.choice("ab  \n\t<>éñ字 the ing1.,ê\r") for _ in range(rng.randrange(300))) for _ in range(100)]
    texts += ["abcdefghij" * 5000, "▁"]
    docs = frame(spark, texts)
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    encoded = encode_documents(docs)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["token_ids"] == lib.encode(t or ""), repr(t)
        assert rows[i]["exact"] == ("▁" not in (t or "")) and rows[i]["n_tokens"] == len(rows[i]["token_ids"])
    for r in decode_documents(encoded).collect():
        assert r["text"] == (texts[r["doc_id"]] or "").replace("▁", " ")
    digest = {r["doc_id"]: r for r in encode_documents(docs, digests=True).collect()}
    for i in rows:
        assert digest[i]["ids_sha256"] == hashlib.sha256(np.array(rows[i]["token_ids"], dtype="<i4").tobytes()).hexdigest()
    assert encode_documents(docs.limit(0)).count() == 0


def unigram_model(pieces, kind=1):
    """A SentencePiece model written field by field: (text, score, type) of each piece, no normalisation but spaces."""
    import struct

    def field(number, data):
        size, head = len(data), b""
        while size > 127:
            head += bytes([size & 127 | 128])
            size >>= 7
        return bytes([number << 3 | 2]) + head + bytes([size]) + data

    body = b"".join(field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([3 << 3, k])) for text, score, k in pieces)
    settings = bytes([3 << 3, kind]) + (b"\x98\x02\x01" if any(k == 6 for *_, k in pieces) else b"")
    normaliser = field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    return body + field(2, settings) + field(3, normaliser)


def test_unigram_vocabularies():
    """Survivors by score: against the best of all cuts, and against the library; unknown kinds are refused."""
    import sentencepiece
    from corpusloom.llm.pieces import MARK, Pieces

    rng = random.Random(7)
    words = {"".join(rng.choice(f"abc{MARK}") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {MARK, "a", "b", "c"}
    # quarters: sums are exact, so that the library's ties are ours
    known = [(w, -rng.randrange(8, 80) / 4, 1) for w in sorted(words)]
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    scores = {w: s for w, s, _ in known}

    def best(text):
        top = [0.0] + [-1e9] * len(text)
        for j in range(1, len(text) + 1):
            top[j] = max((top[i] + scores[text[i:j]] for i in range(j) if text[i:j] in scores), default=-1e9)
        return top[-1]

    for fallback in (False, True):
        model = unigram_model([*special, *([(f"<0x{b:02X}>", -90.0, 6) for b in range(256)] if fallback else ()), *known])
        pieces, lib = Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for n in (1, 5, 30, 300, 1000):
            text = "".join(rng.choice("abc ") for _ in range(n)).strip(" ") or "a"
            ids = pieces.encode(text).tolist()
            assert "".join(pieces.text[i] for i in ids) == MARK + text.replace(" ", MARK) and pieces.decode(ids) == text
            assert sum(pieces.score[i] for i in ids) == pytest.approx(best(MARK + text.replace(" ", MARK)))
            odd = text.replace("b", "é", 3)
            assert len(pieces.encode(odd)) == len(lib.encode(odd)) and pieces.encode(odd).tolist().count(0) == lib.encode(odd).count(0)
    with pytest.raises(ValueError, match="unknown kind"):
        Pieces(unigram_model([*special, *known], kind=3))


def test_pieces_stream_commits_early():
    from corpusloom.llm.pieces import default_model, loaded

    with open(default_model(), "rb") as f:
        pieces = loaded(f.read())
    read = []

    class Text(str):
        def __getitem__(self, at):
            read.append(at if isinstance(at, int) else at.stop)
            return str.__getitem__(self, at)

    stream = pieces.stream(Text("the quick brown fox " * 5000))
    next(stream)
    assert max(read) < 200


PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body class="x">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="sidebar"><p>Related things, many, many, many words in this sidebar paragraph.</p></div>
<div class="wrap"><div class="post-content"><h2>Title &amp; more</h2><p>First, a paragraph   of text,
with commas, long enough to count as one.<br>And a break.<p>Second <b>bold</b> paragraph &mdash; it is unclosed, and long, too.
<blockquote>A quote of some length, with a comma.</blockquote><form><input><p>Sign up here, please, now, to get it.</p></form></div>
<div id="comments"><p>First! What a great, great, great article this is, I say.</p></div></div>
<footer><p>Copyright, all rights reserved, and so on, and so on.</p></footer><script>x</script></body></html>"""


def test_pages(spark):
    from corpusloom.llm.pagetext import extract_pages, main_text

    assert main_text(PAGE).split("\n\n") == [
        "Title & more",
        "First, a paragraph of text, with commas, long enough to count as one. And a break.",
        "Second bold paragraph — it is unclosed, and long, too.",
        "A quote of some length, with a comma.",
    ]
    assert main_text("<p>short") == "short" and main_text("<nav>x</nav>") == "" and main_text("plain &lt; text") == "plain < text"
    assert len(main_text("<div>" * 20_000 + "deep" + "<a b='" * 1000)) < 10_000
    rows = [(0, "u", None, "x"), (1, None, "", "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(0, 0), (1, 0), (2, len(main_text(PAGE))), (2, len(main_text(PAGE)))]
    truth = spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 40")
    for r in extract_pages(truth).join(truth.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in parts if x)


def test_slugs_inside_the_article():
    from corpusloom.llm.pagetext import main_text

    words = "The river rose again in spring, and the mill, as ever, stood in water to the second step."
    inside = f"<section id='side-effects'><h2 id='related-work'>A</h2><p class='legal-text'>{words}</p></section><section id='search'><h2>B</h2><p>{words}</p></section>"
    for tag in ("article", "main"):
        assert main_text(f"<body><{tag}>{inside}</{tag}></body>") == f"A\n\n{words}\n\nB\n\n{words}"
    assert main_text(f"<body><div><h2 id='social-impact'>A</h2><p>{words}</p><div id='search-algorithms'><p>{words}</p></div></div></body>") == f"A\n\n{words}\n\n{words}"


def test_form_around_the_page():
    from corpusloom.llm.pagetext import main_text

    words = "The river rose again in spring, and the mill, as ever, stood in water to the second step."
    body = f"<input name=q><select><option>One</select><div><h1>Mill</h1><p>{words}</p><p>{words}</p></div><button>Send</button>"
    for page in (f"<body><form id='aspnetForm'>{body}</form></body>", f"<body><form><fieldset>{body}</fieldset></form></body>"):
        assert main_text(page) == f"Mill\n\n{words}\n\n{words}"
    assert main_text(f"<body><div><p>{words}</p><form><p>{words[:40]}</p></form></div></body>") == words


def test_short_sections_beside_the_longest():
    from corpusloom.llm.pagetext import main_text

    words, short = "The river rose again in spring, and the mill, as ever, stood in water to the second step.", "Only one short paragraph stands here, of sixty letters or so."
    long = f"<div><h2>Long</h2>{f'<p>{words}</p>' * 9}</div>"
    page = f"<body><div class='nav'><p>{words}</p></div><h1>Mill</h1>{long}<div><h2>Short</h2><p>{short}</p></div><ul><li>One<li>Two</ul><p>End.</p><footer>{words}</footer></body>"
    assert main_text(page).split("\n\n") == ["Mill", "Long", *[words] * 9, "Short", short, "One", "Two", "End."]


def test_lists_titles_and_quotes_of_an_article():
    from corpusloom.llm.pagetext import main_text

    words = "The river rose again in spring, and the mill, as ever, stood in water to the second step."
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Source {i}</a></li>" for i in range(4)) + "</ul>"
    listed = "\n\n".join(f"Source {i}" for i in range(4))
    # sources in an article stay; a nameless menu before the text of a page without one goes
    assert main_text(f"<body><article><p>{words}</p>{links}</article></body>") == f"{words}\n\n{listed}"
    assert main_text(f"<body>{links}<div><p>{words}</p>{links}<p>{words}</p></div>{links}</body>") == f"{words}\n\n{listed}\n\n{words}"
    assert main_text(f"<body><div><h1>Mill</h1><article><p>{words}</p></article><p>End.</p></div></body>") == f"Mill\n\n{words}\n\nEnd."
    # an apostrophe in a value without quotes encloses nothing
    assert main_text(f"<body><div><p title=it's>One's own words, and more of them here.</p><p>{words}</p></div></body>") == f"One's own words, and more of them here.\n\n{words}"
    assert main_text(f"<article><p data-x = 'a > b' data-y=\"c > d\">{words}</p></article>") == words


def test_points_of_random_trees():
    """Scores summed from the leaves up against paragraphs that climb one by one."""
    from corpusloom.llm import pagetext as P

    rng = random.Random(5)
    for _ in range(40):
        def tree(depth):
            if depth == 0 or rng.random() < 0.3:
                return f"<p>{'word, ' * rng.randrange(9)}<a href=x>{'link ' * rng.randrange(4)}</a></p>"
            tag = rng.choice(["div", "section", "blockquote", "ul"])
            return f"<{tag}>{'loose text, ' * rng.randrange(4)}{''.join(tree(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag}>"

        root = P.parse(f"<body>{tree(5)}</body>")
        P._measure(root)
        raw = {}
        for node in P._elements(root):
            own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
            counted = node.chars if node.tag in ("p", "pre") else own
            if (node.tag in P.PARAGRAPHS or own >= 25 and node.tag in P.BLOCK) and counted >= 25:
                points = (1 + node.commas + min(counted / 100, 3)) * (1 - node.linked / max(1, node.chars))
                above, level = (node.parent, 0) if node.tag == "p" else (node, 0)
                while above is not None:
                    raw[id(above)] = raw.get(id(above), 0) + points / 2**level
                    above, level = above.parent, level + 1
        for node in P._elements(root):
            assert node.score == pytest.approx(raw.get(id(node), 0) * (1 - node.linked / max(1, node.chars)))


def test_deep_pages_take_linear_time():
    import time

    from corpusloom.llm.pagetext import main_text

    words = "The river rose again in spring, and the mill, as ever, stood in water."
    for page in ("<div>" * 20_000 + f"<p>{words}</p>", f"<div><p>{words}" * 20_000, "<section>" * 20_000 + "</b></i></article>" * 20_000 + words, f"<blockquote>{words}" * 20_000, "<header>" * 20_000 + words):
        began = time.time()
        main_text(page)
        assert time.time() - began < 6  # a second or two on a quiet machine


def test_names_around_the_article():
    from corpusloom.llm.pagetext import main_text

    words = "The river rose again in spring, and the mill, as ever, stood in water to the second step."
    kept = ("has-sidebar", "page-with-comments", "post tag-legal category-social", "entry-content", "postBody", "article-header", "content")
    gone = ("main-nav", "article-comments", "content-sidebar", "entry-footer", "COMMENTS", "adSlot", "cookie-bar", "post-comments", "comment-list")
    for name in kept:
        assert main_text(f"<body><div class='{name}'><p>{words}</p><p>{words}</p></div></body>") == f"{words}\n\n{words}", name
    for name in gone:
        page = f"<body><div><h1>Mill</h1><p>{words}</p><p>{words}</p><div class='{name}'><p>{words[:40]}</p></div></div></body>"
        assert main_text(page) == f"Mill\n\n{words}\n\n{words}", name
    article = f"<article class='post tag-legal hentry'><p>{words}</p></article><article class='comment-body'><p>{words}</p></article>"
    assert main_text(article) == words


def test_embeddings(spark):
    from corpusloom.llm.pivots import embedding_groups

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x = np.concatenate((x, x[:60] + 0.15 * rng.normal(size=(60, 16)), x[:20], x[:20] * 2)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(len(x) + i, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'z' AS n_links", "1 AS label")
    d = x.astype(np.float64)
    norms = np.sqrt((d * d).sum(axis=1))
    linked = (d @ d.T) / np.outer(norms, norms) >= 0.9
    np.fill_diagonal(linked, False)
    n = len(x)
    pairs = [(int(a), int(b)) for a, b in np.argwhere(linked)] + [(n + 6, n + 7)]
    expected = components(n + len(odd), pairs)
    counts = list(linked.sum(axis=1)) + [0] * 6 + [1, 1]
    for options in ({"named": 16, "pivots": 16, "shared": 1}, {"named": 16, "pivots": 16, "shared": 2, "tile": 30}):
        got = {r["vec_id"]: r for r in embedding_groups(table, **options).collect()}
        assert [got[i]["n_links"] for i in range(len(got))] == counts
        assert [got[i]["component_id"] for i in range(len(got))] == expected
        assert all(got[i]["kept"] == (expected[i] == i) for i in got)
    assert embedding_groups(table.limit(0)).count() == 0


def test_repeated_and_missing_ids_of_vectors(spark):
    from corpusloom.llm.pivots import embedding_groups

    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (5, [0.1, 1.0]), (6, None)]
    got = embedding_groups(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, node int, row string, doc int")).collect()
    assert sorted((r["vec_id"] or 9, r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (1, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (5, 1, 5, True), (6, 0, 6, True), (9, 1, 5, False), (9, 3, 1, False)
    ]


def test_simhash_of_repeated_and_missing_ids(spark):
    from corpusloom.llm.simhash import simhash_dedup, simhash_groups

    docs = clashing(spark, REPEATED)
    got = simhash_groups(docs).collect()
    assert len(got) == len(REPEATED)
    kept = simhash_dedup(docs)
    assert kept.schema == docs.schema
    # three equal texts leave one; null and empty are one group, of which the row with an id stays
    assert sorted((r["doc_id"] or 99, r["text"]) for r in kept.collect()) == [
        (1, "same words in this line here"), (2, "another text\nsame words in this line here"), (2, "gamma only here"), (7, ""), (8, "unlike all others " * 9), (99, "no id at all")
    ]


def test_embedding_recall(spark):
    """A group of near copies that holds a third of the rows, and partners just above the threshold."""
    from corpusloom.llm.pivots import embedding_groups

    rng = np.random.default_rng(4)

    def beside(base, low, high):
        other = rng.normal(size=base.shape)
        other -= (other * base).sum(axis=1, keepdims=True) * base
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        c = rng.uniform(low, high, size=(len(base), 1))
        return c * base + np.sqrt(1 - c * c) * other

    single = rng.normal(size=(2000, 64))
    single /= np.linalg.norm(single, axis=1, keepdims=True)
    near = beside(single[:1500], 0.901, 0.92)
    hot = beside(np.repeat(single[-1:], 1700, axis=0), 0.955, 0.99)
    d = np.concatenate((single, near, hot)).astype(np.float32).astype(np.float64)
    norms = np.sqrt((d * d).sum(axis=1))
    linked = (d @ d.T) / np.outer(norms, norms) >= 0.9
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "vec_id long, embedding array<float>")
    links = {r["vec_id"]: r["n_links"] for r in embedding_groups(table).collect()}
    got, whole = np.array([links[i] for i in range(len(d))]), linked.sum(axis=1)
    assert (got <= whole).all()
    for part in (slice(0, 1500), slice(2000, 3500), slice(3500, None)):
        assert whole[part].sum() > 1000 and got[part].sum() >= 0.97 * whole[part].sum()


def test_toxicity(spark):
    from corpusloom.llm.toxicity import drop_toxic, maximal_segments, score_toxicity, toxicity, train

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == 1 and truth[r["doc_id"]] == 1 for r in rows)
    found, real = sum(r["predicted"] for r in rows), sum(truth[r["doc_id"]] for r in rows)
    assert right >= 0.7 * real and right >= 0.9 * found
    model = train(docs, labels)
    odd = frame(spark, ODD + ["moron " * 1000])
    scored = score_toxicity(odd, model).collect()
    assert len(scored) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    kept = drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert score_toxicity(odd.limit(0), model).count() == 0

    def brute(values):
        """Best segment, then the same to its left and right."""
        best = max(((sum(values[a:b]), a - b, a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return brute(values[:a]) + [(a, b)] + [(b + x, b + y) for x, y in brute(values[b:])]

    # scores of tokens, cost and segments as by hand: the word's own log-odds or its longest known prefix's, signed
    from corpusloom.llm.toxicity import Model, surprise, tokens, toxic_passages

    hand = Model({"bad": 3.0, "wors*": 2.0, "worst": -1.0, "nice": -2.0}, 0.5, 1.0, -1.0)
    text = b"bad, nice worse unknown worst WORSEN nice bad bad"
    by_hand = [2.5, -2.5, 1.5, -0.5, -1.5, 1.5, -2.5, 2.5, 2.5]
    segments, n = toxic_passages(text, hand)
    assert n == len(tokens(text)) == len(by_hand) and [(a, b) for a, b, _ in segments] == [tuple(x) for x in brute(by_hand)]
    assert [s for *_, s in segments] == pytest.approx([sum(by_hand[a:b]) for a, b, _ in segments])
    total = 5.0 + 1.0 - math.log(9)  # lambda S - log(K n) of the best segment alone
    assert surprise(segments[-1:], n, hand) == pytest.approx(total)
    spent = [-s for *_, s in segments]
    assert surprise([], n, hand) == 0 and surprise([(0, 1, x) for x in spent], n, hand) == 0
    odd = clashing(spark, REPEATED)
    kept = drop_toxic(odd, labels)
    assert kept.schema == odd.schema and kept.count() == len(REPEATED)

    rng = random.Random(0)
    for _ in range(200):
        values = [rng.randrange(-9, 9) + rng.random() for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in maximal_segments(values)] == [tuple(x) for x in brute(values)]


def test_licences(spark):
    from corpusloom.llm.licences import scan_licences

    texts = [
        None, "", "Nothing here.", "Intro.\nReleased under the MIT License.\nEnd", "LICENSED UNDER CC BY-NC 4.0. Released under the MIT License.",
        "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp x.\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, x.",
        "You may obtain a copy of the License at x.\nYou may not use this file except in compliance with the License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain "
        "the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. "
        "This software is provided by the copyright holders and contributors as is.",
    ]
    got = {r["doc_id"]: r["licences"] for r in scan_licences(frame(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["MIT"], 4: ["CC-BY-NC-4.0", "MIT"], 5: ["Apache-2.0"], 6: [], 7: ["BSD-2-Clause"]}
    assert scan_licences(frame(spark, texts).limit(0)).count() == 0


def test_wrapped_licences(spark):
    from corpusloom.llm.licences import scan_licences

    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."""
    mit = """Copyright (c) 2020 A Person
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.

You should have received a copy of the GNU General Public License
along with this program."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions.
2. Redistributions in binary form must reproduce the above
   copyright notice.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS"."""
    led = lambda text, mark: "\n".join((mark + " " + x).rstrip() for x in text.split("\n"))
    split = apache.replace("Licensed under the Apache License, Version 2.0 (the \"License\");\ny", "Y")
    texts = [apache, split, mit, gpl, bsd, "/*\n" + led(mit, " *") + "\n */", led(gpl, "#"), led(split, "//")]
    texts += ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: (Apache-2.0 OR GPL-3.0-only WITH Some-exception) AND Zlib", "SPDX-License-Identifier: mit in text."]
    got = [r["licences"] for r in scan_licences(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[:5] == [["Apache-2.0"], ["Apache-2.0"], ["MIT"], ["GPL"], ["BSD-2-Clause"]]
    assert got[5:] == [["MIT"], ["GPL"], ["Apache-2.0"], ["MIT"], ["Apache-2.0", "GPL-3.0", "Zlib"], ["MIT"]]


def test_anchors_of_known_sentences():
    from corpusloom.llm.licences import SENTENCES, anchors

    chosen = anchors(SENTENCES)
    assert len(chosen) < 15 and all(any(w in s.rstrip("*") for w in chosen) for _, s in SENTENCES)
    assert anchors([("a", "one"), ("b", "two*")]) == ["one", "two"]


def test_licence_files_and_headers(spark):
    """The starts of the licence files and their notices, as published: wrapped, commented, and with every paragraph on one line."""
    from corpusloom.llm.licences import scan_licences

    gnu = "GNU {0}GENERAL PUBLIC LICENSE\n   Version {1}\n\n Copyright (C) {2} Free Software Foundation, Inc.{3}\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\nPreamble\n"
    street = "\n 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    notice = "This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2}General Public License as published by\nthe Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version.\n\nThis {0} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY.\n\nYou should have received a copy of the GNU {2}General Public License\nalong with this {0}."
    texts = {
        "Apache-2.0": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.",
        "GPL-2.0": gnu.format("", "2, June 1991", "1989, 1991", "," + street),
        "GPL-3.0": gnu.format("", "3, 29 June 2007", "2007", " <https://fsf.org/>"),
        "LGPL-2.1": gnu.format("LESSER ", "2.1, February 1999", "1991, 1999", street),
        "AGPL-3.0": gnu.format("AFFERO ", "3, 19 November 2007", "2007", " <https://fsf.org/>"),
        "MPL-2.0": 'Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. "Contributor"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n',
        "ISC": 'Copyright (c) 2020, A Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE.',
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary.",
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    }
    more = [
        ("GPL-2.0", notice.format("program", ";", "", ";", "2")), ("GPL-3.0", notice.format("program", ":", "", ", ", "3")), ("AGPL-3.0", notice.format("program", ":", "Affero ", ", ", "3")),
        ("LGPL", notice.format("library", ";", "Lesser ", ";", "2.1")),
    ]
    cases = [*texts.items(), *more]
    unwrapped = [(name, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text))) for name, text in cases]
    led = [(name, "\n".join("# " + x for x in text.split("\n"))) for name, text in more]
    every = cases + unwrapped + led
    got = [r["licences"] for r in scan_licences(frame(spark, [text for _, text in every])).orderBy("doc_id").collect()]
    assert [(name, name in found) for (name, _), found in zip(every, got)] == [(name, True) for name, _ in every]


def test_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= 3 * before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where(~F.col("exact")).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_pipeline_of_odd_rows(spark):
    """Stages on repeated and missing ids, null and empty texts, clashing columns; an empty table passes as one."""
    import corpus_pipeline

    docs = clashing(spark, REPEATED)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        rows = out.collect()
        if name != "mixing":  # which may cut any text to its source's budget
            assert "no id at all" in [r["text"] for r in rows] and None in [r["doc_id"] for r in rows], name
        docs = spark.createDataFrame(rows, docs.schema)
    texts = [r["text"] for r in docs.collect()]
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == len(texts) and all(r["exact"] for r in encoded.collect())
