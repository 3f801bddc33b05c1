"""Byte-level BPE: encoding and decoding whole texts inside Arrow batches.

Pre-tokenisation uses no regular expression. Texts of a batch are joined into one array
of code points; a table gives each its class (letter, number, white space, ...), and
looking one to two places ahead splits the classes whose meaning depends on what follows.
What is left is a small automaton. Each class is a function from states to states, the
functions these generate under composition form a finite monoid, and composition is
associative: so the states before all code points come from one blocked prefix scan over
a composition table. A boundary flag per code point cuts the texts into slices, which go
through a cache of merged pieces.

Fixed values, of the published split rule: contractions 's 't 're 've 'm 'll 'd; runs of
letters, of numbers and of other visible characters, each with one optional space before
it; white space, whose last space before a visible character belongs to that character.
"""

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.llm.common import giving_back, small_batches

# classes of code points, as far as one place and its neighbours tell
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACES, LAST_SPACE, LAST_BLANK, RESET = range(9)
# states: what the run that ends here is
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)

#: White_Space of Unicode (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Code points handled at a time, and merged pieces kept by a worker.
BATCH_CHARS, CACHE_PIECES = 1 << 19, 200_000
_BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this code point."""
    if kind == RESET:
        return ENDED, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return ENDED, False
    if kind in (LETTER, NUMBER):
        run = IN_LETTERS if kind == LETTER else IN_NUMBERS
        return run, state not in (run, AFTER_SPACE)
    if kind in (OTHER, QUOTE2, QUOTE3):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, QUOTE2: ONE_LEFT, QUOTE3: TWO_LEFT}[kind], True
    if kind == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_SPACE if kind == LAST_SPACE else ENDED), True


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """Classes of all code points; per class its monoid element; composition; action on states; boundary flags."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACES
    generators = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    elements = [tuple(range(8)), *dict.fromkeys(generators)]
    for f in elements:  # grows as it is read: the closure under composition
        elements += [h for h in dict.fromkeys(tuple(g[s] for s in f) for g in generators) if h not in elements]
    index = {f: i for i, f in enumerate(elements)}
    composed = np.array([[index[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    boundary = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return kinds, np.array([index[g] for g in generators], np.uint16), composed, np.array(elements, np.uint8), boundary


def _scan(functions: np.ndarray, composed: np.ndarray, action: np.ndarray, start: int) -> np.ndarray:
    """States before each element, by a blocked prefix scan of the composition."""
    n, m = len(functions), len(composed)
    if n <= _BLOCK:
        states, s = np.empty(n, np.uint8), start
        for i, f in enumerate(functions.tolist()):
            states[i] = s
            s = action[f, s]
        return states
    blocks = -(-n // _BLOCK)
    padded = np.zeros(blocks * _BLOCK, np.uint16)  # element 0 is the identity
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    flat = composed.ravel()
    for j in range(1, _BLOCK):
        columns[j] = flat[columns[j - 1].astype(np.int32) * m + columns[j]]
    first = _scan(columns[-1], composed, action, start)
    states = np.empty((_BLOCK, blocks), np.uint8)
    states[0] = first
    acted, wide = action.ravel(), first.astype(np.int32)
    for j in range(1, _BLOCK):
        states[j] = acted[columns[j - 1].astype(np.int32) * 8 + wide]
    return states.T.reshape(-1)[:n]


def piece_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by one separator each, where pieces start in it, and how many pieces each text has."""
    kinds, generators, composed, action, boundary = _tables()
    joined = "\x00".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = kinds[points]
    kind[ends] = RESET
    white = kind == SPACES
    ahead = np.zeros(len(kind), bool)
    ahead[:-1] = white[:-1] & ~white[1:] & (kind[1:] != RESET)
    kind[ahead & (points == 0x20)] = LAST_SPACE
    kind[ahead & (points != 0x20)] = LAST_BLANK
    quotes = np.flatnonzero((points == 0x27) & (kind == OTHER))
    if len(quotes):
        after = np.zeros(len(points) + 2, np.uint32)
        after[: len(points)] = np.where(kind == RESET, 0, points)
        one, two = after[quotes + 1], after[quotes + 2]
        kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        kind[quotes[pair]] = QUOTE3
    states = _scan(generators[kind], composed, action, ENDED)
    starts = np.flatnonzero(boundary[states, kind] & (kind != RESET))
    return joined, starts, np.diff(np.searchsorted(starts, ends), prepend=0)


class Vocabulary:
    """Ranks of byte strings, and merging by them."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.cached: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is merged first, the leftmost of equals."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge_long(piece) if len(piece) > 64 else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and links, so that long pieces take n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[end[i]]))

        while heap:
            _, i, middle, last = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or not alive[middle] or end[middle] != last:
                continue
            alive[middle] = False
            end[i] = last
            if last < n:
                before[last] = i
            offer(i)
            offer(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        joined, starts, counts = piece_starts(texts)
        cached = self.cached
        if len(cached) > CACHE_PIECES:
            cached.clear()
        begin = starts.tolist()
        bounds = np.cumsum(counts).tolist()
        ends = [*begin[1:], len(joined)][: len(begin)]
        # the last piece of a text ends before the separator
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        for k, e in zip(bounds, stop.tolist(), strict=True):
            if k:
                ends[k - 1] = min(ends[k - 1], e)
        pieces = [joined[a:b] for a, b in zip(begin, ends, strict=True)]
        for p in set(pieces).difference(cached):
            cached[p] = np.array(self.merge(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        merged = list(map(cached.__getitem__, pieces))
        return [b"".join(merged[a:b]) for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, ids: bytes) -> bytes:
        """Byte offset in the text at which each token starts, as little-endian unsigned 64-bit integers."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        return np.concatenate([[0], ends[:-1]])[: len(ends)].astype("<u8").tobytes()


@lru_cache(maxsize=2)
def _vocabulary(ranks_file: bytes) -> Vocabulary:
    return Vocabulary(ranks_file)


def read_ranks(path: str) -> bytes:
    """A rank file, read once on the driver; its size is that of a vocabulary, whatever the input."""
    with open(path, "rb") as f:
        return f.read()


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, ranks_file: bytes, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, starts and decoded.

    Whole texts are encoded, without special tokens; a null text is an empty one and has
    no tokens. Null ids, repeated rows and further columns (not read) do no harm; an
    empty table gives no rows. starts holds each token's byte offset, so that a range of
    tokens can be decoded and placed in its text. decoded holds the bytes that decode()
    makes of the ids, here in the same pass: half the Python workers of two passes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks_file)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        try:
            for batch in batches:
                at = 0
                for part in _parts([t or "" for t in batch.column(1).to_pylist()]):
                    ids = vocabulary.encode(part)
                    columns = [batch.column(0).slice(at, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if offsets:
                        columns.append(pa.array([vocabulary.starts(x) for x in ids], pa.binary()))
                    if decoded:
                        columns.append(pa.array([vocabulary.decode(x) for x in ids], pa.binary()))
                    at += len(part)
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            # workers outlive tasks: what one has merged must not stay in memory while others run
            vocabulary.cached.clear()

    names = ["doc_id", "n_tokens", "ids", *["starts"] * offsets, *["decoded"] * decoded]
    schema = f"doc_id {id_type}, n_tokens long, ids binary" + ", starts binary" * offsets + ", decoded binary" * decoded
    return docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(giving_back(run), schema)


def decode(encoded: DataFrame, ranks_file: bytes) -> DataFrame:
    """encoded with a column `decoded` (binary): the bytes of its ids. Null ids give null; other columns pass through."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            decoded = pa.array([None if x is None else vocabulary.decode(x) for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    schema = encoded.select("*", F.lit(None).cast("binary").alias("decoded")).schema
    return encoded.mapInArrow(giving_back(run), schema)


def tokens_as_array(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def op3(spark: SparkSession, docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the ids and of what they decode to."""
    both = encode(docs, read_ranks(ranks_path), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
