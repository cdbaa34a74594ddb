"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice's arcs are the vocabulary's pieces. In a unigram vocabulary, the survivor at a boundary is the arc of the best
total score. In a byte-pair vocabulary, a path is the encoding exactly if each piece is the encoding of itself and each two
neighbours are the encoding of their concatenation; so an arc survives at a boundary only if it is compatible with the
survivor it extends, and one does. Other kinds are refused. Survivors reach back at most the longest piece: once the
backpointer paths of all in that window converge on one boundary, the ids before it are final and are given out.

A mark that follows anything but a mark is such a boundary for every path where no piece runs over one: all survivors pass
it, so what stands between two is encoded by itself and remembered. Longer parts are streamed in the window.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIGRAM, BYTE_PAIR = 1, 2
UNKNOWN = 10.0  # what an unknown character costs below the least score
CHECK = 64  # characters between looks for a common boundary
CACHE = 200_000  # words in each of the two generations
PAIRS = 400_000
STEP = 1 << 20  # bytes of text, about, whose ids are held before they are given out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message: integers for varints, bytes for the rest."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def model_kind(model: bytes) -> int:
    """The kind that a SentencePiece model names in its trainer's settings (1: unigram, also if it names none; 2: byte-pair)."""
    settings = next((v for number, v in _fields(model) if number == 2), b"")
    return next((v for number, v in _fields(settings) if number == 3), UNIGRAM)


class Pieces:
    """A vocabulary read from the bytes of a SentencePiece model of the byte-pair or unigram kind that changes no text but its spaces."""

    def __init__(self, model: bytes):
        self.kind = model_kind(model)
        if self.kind not in (UNIGRAM, BYTE_PAIR):
            raise ValueError(f"unknown kind {self.kind} of a model: unigram (1) and byte-pair (2) are known")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {self.text[i]: i for i in range(n) if i not in self.special and i not in self.byte_of and not sp.is_unused(i)}
        self.score = [sp.get_score(i) for i in range(n)]
        self.least = min(self.score)
        self.longest = max(map(len, self.ids))
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        # no piece runs over a line end, nor over a mark that follows anything but a mark
        self.split_lines = "\n" not in joined
        self.split_marks = not any(MARK in p.lstrip(MARK) for p in self.ids) and MARK in self.ids and len(self.bytes) == 256
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-self.score[i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.arcs: dict = {}  # a tree of the pieces read backwards; under 0 the id of the piece that is complete there
        for piece, i in self.ids.items():
            if len(piece) > 1 and self.kind == BYTE_PAIR:
                parts = self._merged(piece, 2)
                if len(parts) != 2 or parts[0] + parts[1] != piece:
                    continue  # not the encoding of itself: never part of an encoding
                self.halves[i] = (self.ids.get(parts[0], -1), self.ids.get(parts[1], -1))
            node = self.arcs
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[0] = i
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = [b"" if i in self.special else bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]

    def _merged(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair merging by its definition, best neighbours first, until ``least`` parts are left."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, piece: int, side: int) -> list[tuple[int, float]]:
        """The parts of a piece that stand at one of its ends while it is merged, and the rank of the merge that ends each."""
        found = self.spines[side].get(piece)
        if found is None:
            found, end, at = [], float("inf"), piece
            while True:
                found.append((at, end))
                if at not in self.halves:
                    break
                end, at = self.rank[at], self.halves[at][side]
            found.reverse()
            self.spines[side][piece] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay two: no merge over their border comes first while they are built.

        Of the parts that face each other over the border, those that stand at the same time could merge; they do if
        that merge ranks before the ones that end them (of equal ranks, the merge further left is first).
        """
        if left < 0 or right < 0:
            return True
        ours, theirs, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (a, end_a), (b, end_b) = ours[i], theirs[j]
            if a >= 0 and b >= 0:
                over = self.ids.get(self.text[a] + self.text[b])
                if over is not None and self.rank[over] < end_a and self.rank[over] <= end_b:
                    return False
            if end_a <= end_b:
                if i + 1 == len(ours):
                    return True
                i += 1
            else:
                j += 1

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a normalised string's pieces (below zero for a character that is no piece), each given out once final."""
        arcs, pairs, fits, score = self.arcs, self.pairs, self.fits, self.score
        by_score, unknown = self.kind == UNIGRAM, self.least - UNKNOWN
        # of the survivor at base + k: the length of its last piece, the id and, in a unigram vocabulary, the best total score
        base, back, last, total = 0, [0], [-1], [0.0]
        end = len(text)
        for j in range(1, end + 1):
            node, i, length, piece = arcs, j, 1, -1
            best = total[j - 1 - base] + unknown if by_score else 0.0
            while i > base:
                i -= 1
                node = node.get(text[i])
                if node is None:
                    break
                arc = node.get(0)
                if arc is None:
                    continue
                if by_score:
                    reached = total[i - base] + score[arc]
                    # of equal scores the longer piece stays, and any piece before an unknown character
                    if reached >= best or piece < 0 and i == j - 1:
                        best, length, piece = reached, j - i, arc
                    continue
                before = last[i - base]
                if before >= 0:
                    key = before << 20 | arc
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        good = pairs[key] = fits(before, arc)
                    if not good:
                        continue
                length, piece = j - i, arc
                break
            back.append(length)
            last.append(piece)
            if by_score:
                total.append(best)
            if j % CHECK == 0 and j < end:
                boundary = self._converged(back, base, j)
                if boundary > base:
                    yield from self._given(text, back, last, base, boundary)
                    cut = boundary - base
                    back, last, total, base = back[cut:], last[cut:], total[cut:], boundary
        yield from self._given(text, back, last, base, end)

    @staticmethod
    def _given(text: str, back: list[int], last: list[int], base: int, end: int) -> Iterator[int]:
        """The ids of the one path from ``base`` to a final boundary."""
        out, at = [], end
        while at > base:
            known = last[at - base]
            out.append(known if known >= 0 else -1 - ord(text[at - 1]))
            at -= back[at - base]
        yield from reversed(out)

    def _converged(self, back: list[int], base: int, j: int) -> int:
        """The boundary on which the paths of all survivors in the window meet."""
        alive = set(range(max(base, j - self.longest + 1), j + 1))
        while len(alive) > 1:
            latest = max(alive)
            alive.remove(latest)
            alive.add(latest - back[latest - base])
        return alive.pop()

    def _codes(self, part: str) -> bytes:
        """Ids of a part of a text that no piece crosses, as little-endian 32-bit integers."""
        out, open_run = [], False
        for piece in self.stream(part):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes.get(b, self.unknown) for b in chr(-1 - piece).encode("utf-8", "replace")]
            elif not open_run:  # without pieces for bytes, unknown characters in a row are one id
                out.append(self.unknown)
            open_run = piece < 0
        return array("i", out).tobytes()

    def _cached(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self._codes(part)
        if len(part) < CHECK:
            if len(self.cache) > CACHE:  # two generations: what is still in use moves to the new one
                self.older = self.cache.copy()
                self.cache.clear()
            self.cache[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: a mark before it, marks for spaces, nothing else changed; empty for an empty text."""
        if not text:
            return np.zeros(0, dtype="<i4")
        whole = MARK + text.replace(" ", MARK)
        if not self.split_marks:
            return np.frombuffer(self._codes(whole), dtype="<i4")
        lines = whole.split("\n") if self.split_lines else [whole]
        newline = self._cached("\n") if self.split_lines else b""
        out, get = [], self.cache.get
        for number, line in enumerate(lines):
            if number:
                out.append(newline)
            out += [get(part) or self._cached(part) for part in _parts(line)]
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids) -> str:
        """The text of the ids; special ids give nothing, bytes that are no text give the replacement character."""
        plain = self.plain
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The vocabulary of a model, kept for the life of the worker process together with its bounded caches."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _parts(line: str) -> list[str]:
    """A line cut before each mark that follows something else."""
    cut = line.split(MARK)
    if "" not in cut[1:]:
        return [p for p in (cut[0], *[MARK + c for c in cut[1:]]) if p]
    out, run = [cut[0]] if cut[0] else [], 0
    for c in cut[1:]:
        run += 1
        if c:
            out.append(MARK * run + c)
            run = 0
    if run:
        out.append(MARK * run)
    return out


def _steps(batches):
    """Arrow batches of (id, text) cut into slices of about STEP bytes of text; a longer text ends its slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(sizes, dtype=np.int64) - sizes) // STEP
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _vocabulary(model_path: str | None) -> bytes:
    """The model's bytes, read on the driver: executors need not have the file."""
    with open(model_path or default_model(), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str | None = None, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, token_ids (array of int), n_tokens, exact (whether decoding gives the text back).

    Null and empty texts have no ids; texts of any length are encoded whole in a window of the longest piece; repeated
    rows each get a row; an empty table gives an empty result; further columns are ignored. A text that itself holds
    the mark U+2581 decodes to a space there, as with any SentencePiece model: exact is false. With ``digests``, the
    array's place is taken by ids_sha256, over the ids as little-endian 32-bit integers, and text_sha256, of the decoded text.
    """
    model = _vocabulary(model_path)

    def run(batches):
        pieces = loaded(model)
        for batch in _steps(batches):
            made, same, hashed, decoded = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = pieces.encode(text)
                back = pieces.decode(ids.tolist())
                same.append(back == text)
                made.append(ids if not digests else len(ids))
                if digests:
                    hashed.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
            if digests:
                columns = [pa.array(made, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            else:
                columns = [pa.array(made, pa.list_(pa.int32())), pa.array([len(m) for m in made], pa.int64())]
            names = ["n_tokens", "ids_sha256", "text_sha256"] if digests else ["token_ids", "n_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(same, pa.bool_())], names=["doc_id", *names, "exact"])

    what = "n_tokens long, ids_sha256 string, text_sha256 string" if digests else "token_ids array<int>, n_tokens long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {what}, exact boolean")


def decode_documents(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per document: doc_id, text. Null and empty id lists give the empty text."""
    model = _vocabulary(model_path)

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(v.as_py() or ()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
