"""Cleaning, statistics, clones, sources, the pipeline and the stream on small literal cases."""

import gzip
import hashlib
import json
import random
import re
import subprocess

import pytest
from corpusloom.functions import cleaning
from corpusloom.functions.cleaning import clean_lines
from corpusloom.functions.text import n_tokens, one_token
from corpusloom.operators import clones, diffs, messages, outliers
from corpusloom.operators.components import connected_components
from corpusloom.operators.ids import surrogate_ids
from corpusloom.operators.prefix import ranged_prefix
from corpusloom.plans.pipeline import Config, Tables, run, with_stats
from corpusloom.plans.queries import QUERIES
from corpusloom.sources import commits
from corpusloom.streaming.stages import clean_stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LEADS, TAILS = ("", "- ", ": ", "-", ":"), ("", ".", "?", "........", "???", "!!", "~")
THINGS = {
    "[EMAIL]": ["some.one@mail.org", "<a+b@c.co>"],
    "[URL]": ["https://host.org/a?b=c#d", "http://x.y:80/z"],
    "[NICKNAME]": ["@nick", "@under_score"],
    "[ISSUE_ID]": ["#123", "GH-5", "gh-77", "[PROJ-9]", "(#1)"],
    "[COMMIT_ID]": ["0123456789abcdef0123", "ref:deadbeef1", "Iabcdef0123"],
}


def applied(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("replace", [False, True])
def test_things_are_cleaned_wherever_they_stand(spark, replace):
    cases, expected = [], []
    for token, things in THINGS.items():
        for thing in things:
            for lead in LEADS if not replace else ("",):
                for tail in TAILS:
                    for before, after in (("", " end"), ("start ", " end"), ("start ", ""), ("", "")):
                        cases.append(before + lead + thing + tail + after)
                        left = (before + token + tail + after) if replace else (before.strip() + after if before else after.strip())
                        expected.append(left)
    got = applied(spark, cases, lambda x: F.array_join(clean_lines(F.array(x), replace), "\n"))
    assert [(c, g) for c, g, e in zip(cases, got, expected) if g != e] == []


def test_signatures_and_dates(spark):
    texts = ["Fix it Signed-off-by: me <a@b>", "Reviewed-on: https://x", "(cherry picked from abc)", "BUG=12", "see BUG=12", "on 2020-01-02 deadbeef1"]
    got = applied(spark, texts, lambda x: F.array_join(clean_lines(F.array(x)), "\n"))
    assert got == ["Fix it", "", "", "", "see BUG=12", "on 2020-01-02 deadbeef1"]


def test_filters(spark):
    trivial = ["Update README.md", "update changelog", "Bump version to 1.2.3", "prepare version 1.0", "Modify Dockerfile", "update submodules", "ignore update 'x y.", "Updated main.py"]
    fine = ["Update the main file", "Bump it", "prepare the version", "update readme and more"]
    assert applied(spark, trivial + fine, messages.is_trivial) == [True] * len(trivial) + [False] * len(fine)
    squash = ["a\n* b\n * c", "a\n* b\nc", "a", "* a", ""]
    assert applied(spark, squash, messages.is_squash) == [True, False, False, False, False]
    rows = spark.createDataFrame([(None,), ("one",), ("été ici",), ("Merge x y",), ("Keep this",), ("123 456",)], "message string")
    assert sorted(r["message"] for r in messages.clean_messages(rows).collect()) == ["123 456", "Keep this"]


def test_diffs(spark):
    got = applied(spark, ["@@ -1 +1 @@\n a\t b \n\n+c\n@@ -2 @@ f()", "@@ x @@", ""], diffs.clean_diff)
    assert got == ["a b\n+c\n@@ -2 @@ f()\n", "", ""]
    assert applied(spark, ["a\nb"], lambda x: diffs.clean_diff(x, "[NL]")) == ["a[NL]b[NL]"]


def test_mod_statistics(spark):
    schema = commits.MODS
    mods = [("MODIFY", None, "sample_fname", "sample diff")]
    cases = [mods, mods * 5, mods + [("ADD", None, "f", None)], mods + [("UNKNOWN", None, None, None)], [("RENAME", "a", None, "x")], []]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(cases)], f"i int, mods {schema}")
    got = [tuple(r["s"]) for r in rows.select("i", outliers.mods_stats(F.col("mods")).alias("s")).orderBy("i").collect()]
    assert got == [(3, 24, 1), (15, 120, 5), (None, None, None), (3, 24, 2), (7, 30, 1), (0, 0, 0)]
    with pytest.raises(ValueError):
        outliers.check_stats(["nothing"], outliers.DIFF_STATS)


def test_drop_outliers(spark):
    rows = spark.createDataFrame([(i, "train", i) for i in range(1, 101)] + [(101, "train", None)], "id int, part string, n int")
    limits = outliers.percentiles(rows, ["n"])
    assert [round(x, 6) for x in limits.first()] == [5.95, 95.05]
    assert {r["id"] for r in outliers.drop_outliers(rows, limits, ["n"], {"n": 50}).collect()} == set(range(6, 51))


PAIRS = [(1, 2, 1, 1), (1, 3, 1, 2), (1, 5, 1, 3), (1, 7, 1, 6), (1, 8, 1, 7), (1, 9, 2, 4), (2, 4, 1, 10)]


def test_pairs(spark):
    m = spark.createDataFrame(PAIRS, commits.PAIRS)
    d = spark.createDataFrame([(1, 3, 1, 2), (1, 9, 1, 6), (1, 8, 1, 6)], commits.PAIRS)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(clones.pair_clones(m, d, 1)) == {1, 2, 3, 5, 6, 7, 8, 9}
    assert ids(clones.pair_clones(m, d, 1, other=True)) == {9, 10}
    assert ids(clones.similar_full_clones(m, d, 1)) == {2, 3}
    assert ids(clones.identical_full_clones(m, d, 1)) == {2, 3, 6, 8}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    up = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: up[n] for n in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_prefix(spark):
    rows = [(g, i, v) for g in ("a", None) for i, v in enumerate([3, 1, 4, 1, 5, 9])]
    df = ranged_prefix(spark.createDataFrame(rows, "g string, i int, v long"), "g", F.expr("i div 2"), ["i"], "v", "s")
    assert {(r["g"], r["i"], r["s"]) for r in df.collect()} == {(g, i, sum([3, 1, 4, 1, 5, 9][:i])) for g, i, _ in rows}


def write_repo(root, part, repo, rows):
    folder = root / part / repo
    folder.mkdir(parents=True)
    with gzip.open(folder / "commits.jsonl.gz", "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def commit(i, message, diff, author="ann"):
    return {
        "author": [author, f"{author}@x.org"], "date": "01.02.2020 03:04:05", "timezone": 0, "hash": f"h{i}", "message": message,
        "mods": [{"change_type": "MODIFY", "old_path": "a", "new_path": "a", "diff": diff}],
    }


@pytest.fixture
def corpus(tmp_path):
    train = [commit(i, f"Fix number {i} of many", f"@@ x @@\n+line {i} one\n-line two") for i in range(20)]
    train += [commit(30, "Same message here", "+d one two"), commit(31, "Same message here", "+e three four"), commit(32, "Shared with val set", "+f five six")]
    train += [commit(33, "By a robot now", "+g one two", "helperbot"), commit(34, "1234 5678", "+h one two"), commit(35, "From bob alone", "+i j k", "bob")]
    write_repo(tmp_path, "train", "org#one", train)
    write_repo(tmp_path, "val", "org#two", [commit(40, "Shared with val set", "+v one two", "bob")])
    write_repo(tmp_path, "test", "org#two", [commit(50, "A test message here", "+t one two", "eve")])
    return str(tmp_path)


def test_pipeline_and_sources(spark, corpus, tmp_path):
    raw = commits.read_commits(spark, corpus)
    assert {r["repo"] for r in raw.select("repo").distinct().collect()} == {"org#one", "org#two"}
    named = raw.withColumns({"name": F.col("author")[0], "email": F.col("author")[1]})
    bots = spark.createDataFrame([("zed", "", "")], "name string, login string, email string")
    repos = spark.createDataFrame([("org/two", "D", "X", 0), ("org/one", "Go", "MIT", 1), ("org/two", "C", "BSD", 2)], "name string, mainLanguage string, license string, line int")
    out = run(named, Tables(bots=bots, repos=repos), Config(outliers=False))
    got = {r["hash"]: r for r in out.collect()}
    assert set(got) == {f"h{i}" for i in range(20)} | {"h34", "h40", "h50"}
    assert (got["h3"]["language"], got["h40"]["license"]) == ("Go", "BSD")
    assert got["h3"]["mods"][0]["diff"] == "+line 3 one\n-line two\n"
    again = clones.drop_clones(clones.add_hashes(out.withColumn("_id", F.concat("repo", "hash"))), "_id")
    assert again.count() == out.count()
    commits.write_commits(out.select("part", "repo", "hash", "message"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == len(got)
    assert run(named, config=Config(metadata=False)).count() <= len(got) + 3
    with pytest.raises(ValueError):
        commits.read_commits(spark, corpus, data_format="xml")


def test_missing_metadata_fails_only_if_strict(spark):
    from corpusloom.operators.metadata import add_repo_metadata

    rows = spark.createDataFrame([("org#x",)], "repo string")
    repos = spark.createDataFrame([("org/y", "Go", "MIT", 0)], "name string, mainLanguage string, license string, line int")
    assert add_repo_metadata(rows, repos, "line", strict=False).first()["language"] is None
    with pytest.raises(Exception, match="no metadata"):
        add_repo_metadata(rows, repos, "line").collect()


def test_stream_gives_what_the_batch_gives(spark, corpus, tmp_path):
    raw = commits.read_commits(spark, corpus).drop("author")
    raw.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    batch = diffs.clean_diffs(messages.clean_messages(raw))
    key = lambda df: sorted((r["hash"], r["message"]) for r in df.collect())
    assert key(spark.table("cleaned")) == key(batch) and re.match(r"\w", key(batch)[0][1])


def test_aligned_files(spark, tmp_path):
    n = 3000
    for name, extra in (("msg", 5), ("sha", 0)):
        (tmp_path / name).write_text("".join(f" {name} {i} \n" for i in range(n + extra)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
        rows = commits.read_aligned(spark, {name: str(tmp_path / name) for name in ("msg", "sha")}).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {(r["msg"], r["sha"]) for r in rows} == {(f"msg {i}", f"sha {i}") for i in range(n)} and len(rows) == n


def test_mining(spark, tmp_path):
    from corpusloom.sources.gitlog import MINED, mine_commits

    repo = tmp_path / "r"
    repo.mkdir()

    def git(*args, date="2020-02-01T03:04:05+0130"):
        env = {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "HOME": str(tmp_path), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x.org", *args], cwd=repo, env=env, check=True, capture_output=True)

    git("init", "-q")
    (repo / "a.txt").write_text("one\ntwo\nthree\nfour\n")
    (repo / "bin").write_bytes(bytes(range(256)))
    git("add", "."), git("commit", "-qm", "First\n\nbody line")
    (repo / "a.txt").write_text("one\n-- two\nthree\nfour\n")
    git("commit", "-qam", "Second", date="2020-02-02T03:04:05-0500")
    git("mv", "a.txt", "b.txt"), git("commit", "-qm", "Third")
    (repo / "b.txt").unlink(), git("commit", "-qam", "Fourth")
    (repo / "big").write_text("x\n" * 50), git("add", "."), git("commit", "-qm", "Too big")
    repos = spark.createDataFrame([("org#r", str(repo)), ("org#none", str(tmp_path / "none"))], "repo string, path string")
    rows = mine_commits(repos, max_lines=20, chunk=2).collect()
    assert [r["message"] for r in rows] == ["First\n\nbody line", "Second", "Third", "Fourth"]
    assert (rows[0]["date"], rows[0]["timezone"], rows[1]["timezone"], list(rows[0]["author"])) == ("01.02.2020 03:04:05", -5400, 18000, ["Ann", "a@x.org"])
    first = {m["new_path"]: m for m in rows[0]["mods"]}
    assert first["a.txt"]["diff"] == "@@ -0,0 +1,4 @@\n+one\n+two\n+three\n+four\n" and first["a.txt"]["old_path"] is None
    assert first["bin"]["change_type"] == "ADD" and first["bin"]["diff"].startswith("Binary files")
    assert rows[1]["mods"][0].asDict() == {"change_type": "MODIFY", "old_path": "a.txt", "new_path": "a.txt", "diff": "@@ -1,4 +1,4 @@\n one\n-two\n+-- two\n three\n four\n"}
    assert rows[2]["mods"][0].asDict() == {"change_type": "RENAME", "old_path": "a.txt", "new_path": "b.txt", "diff": ""}
    assert (rows[3]["mods"][0]["change_type"], rows[3]["mods"][0]["new_path"]) == ("DELETE", None)
    assert mine_commits(repos.limit(0)).count() == 0 and MINED.startswith("repo string")


def test_split_of_one_stratum(spark):
    from corpusloom.operators.stats import stratified_split

    rows = spark.createDataFrame([(i, None if i % 3 else "b") for i in range(300)], "id long, g string")
    out = stratified_split(rows, "g", "id")
    got = {(r["g"], r["part"]): r["count"] for r in out.groupBy("g", "part").count().collect()}
    assert got == {(g, p): n for g, sizes in ((None, (160, 20, 20)), ("b", (80, 10, 10))) for p, n in zip(("train", "val", "test"), sizes)}
    assert out.columns == ["id", "g", "part"]


def test_surrogate_ids(spark):
    rows = [("b", 5), ("a", 7), ("b", 1), (None, 3), ("c", 7), ("a", 7)]
    df = spark.createDataFrame(rows, "k string, at int").repartition(3)
    got = {r["k"]: r["id"] for r in surrogate_ids(df, ["k"], ["at"]).collect()}
    assert got == {"b": 0, None: 1, "a": 2, "c": 3}
    many = spark.range(1000).selectExpr("id AS k", "1000 - id AS at")
    assert all(r["id"] == 999 - r["k"] for r in surrogate_ids(many, ["k"], ["at"]).collect())
    assert surrogate_ids(df.limit(0), ["k"], ["at"]).count() == 0


def test_files_of_clone_search(spark, tmp_path):
    """Encoded examples, their hashes, groups gathered into one file, pairs, the map of ids: written and read again."""
    rows = spark.createDataFrame([(0, "a b a"), (1, "b a a"), (2, "a b a"), (3, "..."), (4, "c")], "id int, text string")
    for part, n in (("train", 1), ("val", 2)):
        lines = clones.encoded_lines(rows, F.lit(n), "id", F.col("text"))
        lines.write.text(str(tmp_path / part))
    first = sorted(r["value"] for r in spark.read.text(str(tmp_path / "train")).collect())
    assert first[0].startswith("1,0,3,2,") and first[0].endswith("@#@a@@::@@2,b@@::@@1") and first[1].endswith("@#@b@@::@@1,a@@::@@2") and first[3].endswith("@#@")
    files = {p: str(tmp_path / p) for p in ("train", "val")}
    plain = commits.write_hashes(spark, files, str(tmp_path / "h"), ("train", "val"), tokens_hash=False)
    bags = commits.write_hashes(spark, files, str(tmp_path / "b"), ("train", "val"))
    assert plain.count() == bags.count() == 8  # an example without tokens has no hash
    commits.write_groups(commits.hash_groups(plain), str(tmp_path / "g"))
    commits.gather_groups(spark, str(tmp_path / "g"), str(tmp_path / "one"))
    made = [r["clones"] for r in spark.read.json(str(tmp_path / "one")).collect()]
    assert sorted(made) == [[[1, 0], [1, 2], [2, 0], [2, 2]], [[1, 1], [2, 1]], [[1, 4], [2, 4]]]
    assert sorted(map(len, (r["clones"] for r in commits.hash_groups(bags).collect()))) == [2, 6]
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    with pytest.raises(ValueError, match="train"):
        commits.write_hashes(spark, files, str(tmp_path / "x"), ("val", "train"))
    (tmp_path / "pairs.csv").write_text("1,0, 2,5\n1,3,1,4\n")
    assert [tuple(r) for r in commits.read_pairs(spark, str(tmp_path / "pairs.csv")).collect()] == [(1, 0, 2, 5), (1, 3, 1, 4)]
    ids = spark.createDataFrame([("r", "h1", 0), ("r", "h2", 1)], "repo string, hash string, id long")
    commits.write_id_map(ids, str(tmp_path / "ids"))
    assert sorted(map(tuple, commits.read_id_map(spark, str(tmp_path / "ids")).collect())) == [("r", "h1", 0), ("r", "h2", 1)]


def test_lists_of_repositories(spark, tmp_path):
    (tmp_path / "repos.json").write_text('{"name": "a/b", "github_url": "git://x/a/b"}\n{"name": "c", "github_url": "https://x/c"}\n')
    listed = commits.read_repo_list(spark, str(tmp_path / "repos.json"))
    assert sorted(map(tuple, listed.collect())) == [("a#b", "https://x/a/b"), ("c", "https://x/c")]
    assert [r["name"] for r in commits.without_done(listed, listed.where("name = 'c'")).collect()] == ["a#b"]
    (tmp_path / "search.csv").write_bytes(b"name,commits,mainLanguage,other\nx,12,Go\xff,z\ny,many,C,w\n")
    found = {r["name"]: (r["commits"], r["mainLanguage"]) for r in commits.read_search_results(spark, str(tmp_path / "search.csv")).collect()}
    assert found == {"x": (12, "Go"), "y": (None, "C")}


def test_appending_and_formats(spark, tmp_path):
    rows = spark.createDataFrame([("train", "o#r", "h", "m")], "part string, repo string, hash string, message string")
    for form in ("jsonl", "parquet"):
        commits.write_commits(rows, str(tmp_path / form), form)
        commits.write_commits(rows, str(tmp_path / form), form, append=True)
    assert commits.read_commits(spark, str(tmp_path / "parquet"), data_format="parquet").count() == 2
    commits.append_rows(rows.select(F.col("hash").alias("value")), str(tmp_path / "t"))
    commits.append_rows(rows.select(F.col("hash").alias("value")), str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["h", "h"]
    commits.register_format("lines", lambda s, root, parts, schema: s.read.text(root), lambda w, root: w.text(root))
    assert commits.read_commits(spark, str(tmp_path / "t"), data_format="lines").count() == 2
    del commits.FORMATS["lines"]
    commits.write_diff_text(spark.createDataFrame([("train", ["a", "b"]), ("val", ["c"])], "part string, d array<string>").select("part", F.expr("transform(d, x -> named_struct('diff', x)) AS mods")), str(tmp_path / "d"), "|")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["a|b"]


def test_judgements_of_parsers(spark):
    from corpusloom.operators import filters

    rows = spark.createDataFrame([(0, "Fix bug"), (1, "bugs. More"), (2, None)], "id int, text string")
    vdo = filters.per_text(lambda x: x.split(" ")[0] == "Fix")
    got = rows.select("id", *filters.filter_row(F.col("text"), F.col("text"), vdo(F.col("text")), punct=filters.per_text(lambda x: [True, False][x.count(".")]))).orderBy("id").collect()
    assert [(r["is_vdo"], r["first_sentence_punct"], r["message_30_tokens"]) for r in got] == [(True, True, True), (False, False, True), (None, None, None)]
    assert filters.starts_with_verb_and_object([("VERB", "ROOT", 0), ("NOUN", "dobj", 1)]) and not filters.starts_with_verb_and_object([("NOUN", "ROOT", 0)])
    assert filters.first_verb_has_object([("VERB", "root", 0), ("ADV", "advmod", 1), ("NOUN", "obj", 1)]) and filters.first_verb_has_object([]) is None
    with pytest.raises(ValueError):
        filters.is_one_sentence(F.col("text"), "lines")
    with pytest.raises(Exception, match="no judgement for 2"):
        filters.with_judgements(rows, spark.createDataFrame([(0, True), (1, True)], "id int, judged boolean"), ["id"]).collect()


def test_stages_and_counts(spark):
    import pandas as pd
    from corpusloom.operators.stats import counted
    from corpusloom.plans.stages import chain, pandas_stage, stage

    rows = spark.createDataFrame([(1, 5, 5), (2, 1, 9)], "id int, n_unique_msg int, n_unique_diff int")
    from corpusloom.operators.metadata import drop_short

    both = chain([stage(drop_short, columns=("n_unique_msg",)), pandas_stage(lambda pdf: pd.DataFrame({"id": pdf["id"] * 10}), "id int")])
    df, seen = counted(both(rows), "kept")
    assert [r["id"] for r in df.collect()] == [10] and seen.get["n"] == 1


def test_paired_clones_and_parts_without_an_id(spark):
    rows = spark.createDataFrame([("train", "r", f"h{i}") for i in range(4)] + [("val", "r", "h9")], "part string, repo string, hash string")
    ids = spark.createDataFrame([("r", f"h{i}", i) for i in (0, 1, 2, 3, 9)], "repo string, hash string, id long")
    pairs = spark.createDataFrame([(1, 0, 1, 1)], "part_id1 int, id1 long, part_id2 int, id2 long")
    outer = spark.createDataFrame([(2, 9, 1, 3)], "part_id1 int, id1 long, part_id2 int, id2 long")
    config = Config(outliers=False, messages=False, diffs=False, metadata=False)
    kept = run(rows, Tables(message_pairs=pairs, diff_pairs=outer, id_map=ids), config)
    assert {r["hash"] for r in kept.collect()} == {"h2", "h9"}
    with pytest.raises(ValueError, match="no id"):
        run(rows, Tables(message_pairs=pairs, diff_pairs=outer, id_map=ids, part_ids={"train": 1}), config)


def test_tokenizer_parts(tmp_path):
    from corpusloom.sources.tokenizers import build_tokenizer, make, save_tokenizer, tokenizer_tokens

    assert tokenizer_tokens(messages=True)[:6] == ["[PAD]", "[UNK]", "[BOS]", "[EOS]", "[SEP]", "[MASK]"] and "[URL]" in tokenizer_tokens(messages=True)
    made = build_tokenizer("custom", pre_tokenizer={"type": "Whitespace"}, normalizer={"type": "Lowercase"})
    save_tokenizer(made, str(tmp_path / "t"))
    held = json.loads((tmp_path / "t" / "diff_tokenizer.json").read_text())
    assert held["pre_tokenizer"]["type"] == "Whitespace" and "[LONG]" in {t["content"] for t in held["added_tokens"]}
    assert json.loads((tmp_path / "t" / "special_tokens_map.json").read_text())["cls_token"] == "[BOS]"
    for bad in (lambda: build_tokenizer("other"), lambda: make("trainer", {"type": "BpeTrainer"}), lambda: make("model", {"type": "None"})):
        with pytest.raises(ValueError):
            bad()


def test_rows_of_any_id(spark):
    from corpusloom.operators.rows import keyed_rows

    one = spark.createDataFrame([(5, "a"), (3, "b")], "id int, row string")
    assert sorted((r["row"], r["doc"]["row"]) for r in keyed_rows(one, "id").collect()) == [(3, "b"), (5, "a")]
    many = spark.createDataFrame([(2, "a"), (None, "z"), (1, "b"), (2, "a"), (None, "y")], "id int, row string")
    got = keyed_rows(many, "id").collect()
    assert len({r["row"] for r in got}) == 5 and [r["doc"]["id"] for r in sorted(got, key=lambda r: r["row"])] == [1, 2, 2, None, None]
    assert keyed_rows(many.limit(0), "id").count() == 0


def test_first_of_each_text_in_a_stream(spark, tmp_path):
    from corpusloom.streaming.stages import first_within

    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "text string, s long").select("text", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_within(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "text", "at", "1 hour")
    stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r["text"] for r in spark.table("firsts").collect()) == ["a", "b"]


def test_enrichment_resumes(spark, tmp_path):
    from corpusloom.sources.enrich import enrich

    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")

    def fetch(name):
        if name == "b":
            raise OSError("no such repository")
        return {"stars": len(name), "license": "MIT"}

    first = enrich(names.where("name < 'c'"), fetch, "stars long, license string")
    commits.append_rows(first, str(tmp_path / "out"))
    done = spark.read.schema("name string, stars long, license string").json(str(tmp_path / "out"))
    assert sorted(map(tuple, done.collect())) == [("a", 1, "MIT"), ("b", None, None)]
    assert [tuple(r) for r in enrich(names, fetch, "stars long, license string", done).collect()] == [("c", 1, "MIT")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_saved_thresholds_measure_texts_once(spark):
    assert "regexp" not in plan_of(QUERIES["thresholds_saved"](spark, SF))
    texts = ["a b", " \u3000é\u00a0x\x1cy\n", "", "\u2003", "wörter ~!  z"]
    assert applied(spark, texts, n_tokens) == [2, 3, 0, 0, 3]


def test_messages_are_cleaned_once(spark):
    rows = spark.createDataFrame([(1, "Fix a@b.org it now")], "id int, message string")
    for replace in (False, True):
        plan = plan_of(messages.clean_messages(rows, replace=replace))
        assert [x for x in plan.split("\n") if "Filter" in x and "regexp_replace" in x] == []


def test_cheap_tests_of_messages_agree_with_whole_ones(spark):
    squash = {"a\n* b": True, "a\n\n* b": False, "a\n \t* b\n": False, "\n*": True, "a\n  *\n\x1c* c": True, "a\n b\n* c": False, "\n": False}
    assert applied(spark, list(squash), messages.is_squash) == list(squash.values())
    assert applied(spark, ["a", " a \n", "\u3000é ", "a b", " ", "", "a\u00a0b"], one_token) == [True, True, True, False, False, False, False]
    assert applied(spark, [" \n UPDATE readme", "-update readme", "updates", "x update readme"], messages.is_trivial) == [True, False, False, False]


def test_encoded_lines_read_tokens_once(spark):
    rows = spark.createDataFrame([(3, "b a\x0b,b;\x0b é.a"), (4, " ;")], "id long, text string")
    lines = clones.encoded_lines(rows, F.lit(1), "id", F.col("text"))
    assert "lambdafunction" not in plan_of(lines)
    digest = [hashlib.md5(t.encode()).hexdigest() for t in ("b a\x0b,b;\x0b é.a", " ;")]
    assert [r["value"] for r in lines.orderBy("value").collect()] == [f"1,3,6,4,{digest[0]}@#@b@@::@@2,a@@::@@2,@@::@@1,é@@::@@1", f"1,4,0,0,{digest[1]}@#@"]


def test_hashes_of_encoded_lines_sort_no_arrays(spark):
    lines = spark.createDataFrame([("1,3,4,3,aa@#@b@@::@@1,a1@@::@@1,a@@::@@2",), ("1,4,0,0,bb@#@",)], "value string")
    found = clones.hashes_of_encoded(lines)
    assert "lambdafunction" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [(1, 3, hashlib.md5(b'{"a": 2, "a1": 1, "b": 1}').hexdigest())]


def test_tests_before_patterns_let_all_matches_through(spark):
    signed = ["Signed-off-by", "co-authored-by", "coauthored by", "ALSO by", "reviewe by", "Reviewed-on", "former commit id", "git-svn-id", "Auto-Submit", "commit-queue", "Created by MOE", "MOE_MIGRATED_REVID"]
    signed += ["fbshipit-source-id", "Differential Revision", "Pulled-by", "change-id", "PiperOrigin-RevId", "BAZEL_VERSION_REV_ID", "kubernetes-commit", "Revision: r", "Sandbox task ID", "glycine run id"]
    signed += ["(Merged from", "(cherry picked from", "(cherry-picked from", "tracked on"]
    lines = [f"{before}{s} x" for s in signed for before in ("", "a\t")] + ["Bug:1", "BUG=1", "FIXES=1", "R=1"]
    assert [x for x, y, z in zip(lines, applied(spark, lines, cleaning._signed), applied(spark, lines, lambda x: cleaning.signatures(x) != x)) if not (y and z)] == []
    hashes = ["0123abc", "x -:ref:0123abc", "x Iabcdef0.", "--0123abc"]
    assert applied(spark, hashes, cleaning._hashed) == [True] * 4
    assert applied(spark, ["decade0", "facadexx", "see xdeadbeef1"], cleaning._hashed) == [True, False, False]


def test_outliers_are_dropped_without_measuring_again(spark):
    assert "regexp" not in plan_of(QUERIES["outlier_drop"](spark, SF))
    commits_ = spark.createDataFrame([("train", "a b", []), ("train", "c d", [])], f"part string, message string, mods {commits.MODS}")
    sized = with_stats(commits_)
    plan = plan_of(outliers.drop_outliers(sized, outliers.percentiles(sized, ["msg_num_tokens"]), ["msg_num_tokens"]))
    assert [x for x in plan.split("\n") if "Filter" in x and "regexp" in x] == []
