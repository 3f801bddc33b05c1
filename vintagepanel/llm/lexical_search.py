"""Ranked lexical search with Block-Max MaxScore over shards of documents.

The index is cut by documents: a task reads documents, and each time it holds enough of
them writes a shard, with no shuffle. A shard has for each term the list of its documents
and counts, in blocks of 128: gaps and counts as variable-length integers, and beside each
block its last document, its first byte and its competitive pairs (count, length), those
that no other posting of the block beats in both. A bound of a block follows from the
pairs once the number of documents and their mean length are known.

Shards are searched in groups, each by one task that reads its queries first and then a
shard at a time, holding a heap of the best per query. The largest contribution of a term
in the whole index splits a query's lists: those whose bounds together do not reach the
heap's least are not essential. Documents of the essential lists, a window of them at a
time, are candidates; a bound from the maxima of the blocks of the other lists in which a
candidate would lie rejects most of them before any such block is decompressed. Bounds
that equal the heap's least are kept, as ties go to the smaller doc_id. At last the heaps
of the groups are merged.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vintagepanel.llm.common import giving_back, salted_join, scratch_table, small_batches, text_of

#: Postings of a block; documents and terms (with repeats) at which a shard is closed; documents of a window.
BLOCK, SHARD_DOCS, SHARD_TERMS, WINDOW = 128, 32_768, 4_000_000, 4096
#: Items searched by one task at a time; shards of a group, and the most groups; rows of the table of query terms that are broadcast.
ITEM_BLOCK, GROUP_SHARDS, MAX_GROUPS, BROADCAST_ROWS = 1024, 4, 16_384, 100_000

#: A-Z to a-z; what parts terms to blanks. In UTF-8 all bytes of other characters belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as 7 bits a byte, the high bit set but in the last; and the number of bytes of each."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >> bits > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for nth in range(int(size.max(initial=0))):
        has = size > nth
        more = (size[has] > nth + 1).astype(np.uint8) << 7
        out[ends[has] - size[has] + nth] = (values[has] >> 7 * nth & 0x7F).astype(np.uint8) | more
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << 7 * nth, starts) if len(ends) else np.zeros(0, np.int64)


#: The rows of an index: of a shard's documents (term is null; docs and lengths), and one per term.
INDEX = "shard string, n_docs long, n_terms long, docs array<long>, lengths array<int>, term binary, df int, last array<int>, at array<int>, tops array<struct<block:int,tf:int,n:int>>, data binary"


def _lists(items: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists of items; ends[i] is where list i ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items if isinstance(items, pa.Array) else pa.array(items, kind))


class _Shard:
    """A shard that is being filled."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms_of(text)
        if found:
            counted = Counter(found)
            self.ids.append(doc_id)
            self.lengths.append(len(found))
            self.terms.append(np.fromiter(map(self.number.__getitem__, counted), np.int32, len(counted)))
            self.counts.append(np.fromiter(counted.values(), np.int32, len(counted)))
            self.held += len(found)

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        """The shard's rows in batches; none without documents."""
        if not self.ids:
            return
        kinds = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("term", pa.binary()), ("df", pa.int32()), ("last", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("tops", pa.list_(pa.struct([("block", pa.int32()), ("tf", pa.int32()), ("n", pa.int32())]))), ("data", pa.binary())])
        one = {"shard": name, "n_docs": len(self.ids), "n_terms": self.held, "docs": self.ids, "lengths": self.lengths}
        yield pa.RecordBatch.from_pylist([one], schema=kinds)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int64), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts).astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        n = np.asarray(self.lengths, np.int64)[doc]
        df = np.bincount(term, minlength=len(self.number))
        begins = np.concatenate([[0], np.cumsum(df)[:-1]])
        within = np.arange(len(term)) - begins[term]
        starts = np.flatnonzero(within % BLOCK == 0)  # of blocks
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        ends = np.append(starts[1:], len(term)) - 1
        gaps = np.where(within == 0, doc, np.diff(doc, prepend=0)) - (within > 0)
        data, size = pack(np.stack([gaps, tf - 1], 1).reshape(-1))
        byte = np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(1))])
        # competitive pairs: by falling count, those whose length is below all before; offsets part the blocks
        ranked = np.lexsort((n, -tf, block))
        apart = n[ranked] - block[ranked] * (int(n.max()) + 1)
        lowest = np.minimum.accumulate(apart)
        top = ranked[np.concatenate([[True], apart[1:] < lowest[:-1]])]
        blocks_of = np.cumsum(-(-df // BLOCK))
        first_block = np.concatenate([[0], blocks_of[:-1]])
        tops = pa.StructArray.from_arrays([pa.array(block[top] - first_block[term[top]], pa.int32()), pa.array(tf[top], pa.int32()), pa.array(n[top], pa.int32())], ["block", "tf", "n"])
        name_of = list(self.number)
        data_ends = byte[begins + df]
        columns = {
            "last": _lists(doc[ends], blocks_of, pa.int32()),
            "at": _lists(byte[starts] - byte[begins[term[starts]]], blocks_of, pa.int32()),
            "tops": _lists(tops, np.cumsum(np.bincount(term[top], minlength=len(df))), kinds.field("tops").type),
            "data": pa.BinaryArray.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(np.concatenate([[0], data_ends]).astype(np.int32)), pa.py_buffer(data)]),
        }
        none = {"n_docs": pa.int64(), "n_terms": pa.int64(), "docs": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32())}
        columns |= {"shard": pa.array([name]).take(pa.array(np.zeros(len(df), np.int64))), "term": pa.array(name_of, pa.binary()), "df": pa.array(df, pa.int32()), **{c: pa.nulls(len(df), k) for c, k in none.items()}}
        whole = pa.RecordBatch.from_arrays([columns[f.name] for f in kinds], schema=kinds)
        for first in range(0, len(df), 8192):
            yield whole.slice(first, 8192)


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of docs (doc_id, text), in the shared folder. Texts without a term, null ones among them, are not in it."""
    small_batches(docs.sparkSession)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, shard = None, 0, _Shard()
        for batch in batches:
            for p, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = p
                shard.add(doc_id, text)
                if shard.held >= shard_terms or len(shard.ids) >= shard_docs:
                    yield from shard.rows(f"{part}-{nth}")
                    nth, shard = nth + 1, _Shard()
        yield from shard.rows(f"{part}-{nth}")

    read = docs.select(F.spark_partition_id().alias("part"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return scratch_table(read.mapInArrow(run, INDEX), "lexical-index")


def length_part(n: Column, n_docs: int, n_terms: int) -> Column:
    """m of a document of n terms."""
    return F.lit(75) + F.call_function("div", F.lit(25) * n * F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long"))


def impact(tf: Column, m: Column) -> Column:
    """What an occurrence count gives before it is weighted."""
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(12).cast("long") * m)


@dataclass
class _Terms:
    """A list of a shard: decompressed block by block, when asked for."""

    last: np.ndarray
    at: np.ndarray
    data: np.ndarray
    df: int
    maxima: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    ready: np.ndarray

    def decompress(self, blocks: np.ndarray, m: np.ndarray) -> int:
        """Fill docs and impacts of the blocks; how many were not there yet."""
        todo = blocks[~self.ready[blocks]]
        for b in todo:
            end = self.at[b + 1] if b + 1 < len(self.at) else len(self.data)
            pairs = unpack(self.data[self.at[b] : end]).reshape(-1, 2)
            rows = slice(b * BLOCK, b * BLOCK + len(pairs))
            docs = np.cumsum(pairs[:, 0] + 1) + (self.last[b - 1] if b else -1)
            tf = pairs[:, 1] + 1
            self.docs[rows] = docs
            self.impacts[rows] = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
        self.ready[todo] = True
        return len(todo)


class Heap:
    """The k best (score, doc_id) of a query; ties to the smaller doc_id, documents without one last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nameless = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that a document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        scores, ids, nameless = (np.concatenate(z) for z in ((self.scores, scores), (self.ids, ids), (self.nameless, nameless)))
        best = np.lexsort((ids, nameless, -scores))[: self.k]
        self.scores, self.ids, self.nameless = scores[best], ids[best], nameless[best]


class Searched:
    """A shard with the lists of the terms that are asked for."""

    def __init__(self, docs: list[int | None], lengths: np.ndarray, n_docs: int, n_terms: int):
        self.nameless = np.array([d is None for d in docs])
        self.ids = np.array([d or 0 for d in docs], np.int64)
        self.m = 75 + 25 * lengths.astype(np.int64) * n_docs // n_terms
        self.n_docs, self.n_terms, self.terms, self.decompressed = n_docs, n_terms, {}, 0

    def add(self, term: bytes, df: int, last: np.ndarray, at: np.ndarray, block: np.ndarray, tf: np.ndarray, n: np.ndarray, data: bytes) -> None:
        tf, m = tf.astype(np.int64), 75 + 25 * n.astype(np.int64) * self.n_docs // self.n_terms
        maxima = np.zeros(len(last), np.int64)
        np.maximum.at(maxima, block, 1_000_000_000 * tf // (1000 * tf + 12 * m))
        self.terms[term] = _Terms(last, at, np.frombuffer(data, np.uint8), df, maxima, np.zeros(df, np.int64), np.zeros(df, np.int64), np.zeros(len(last), bool))

    def search(self, query: list[tuple[bytes, int, int]], heap: Heap) -> None:
        """query: term, weight (with its repeats) and bound in the whole index; the least bounds first."""
        lists = [(self.terms[t], w, bound) for t, w, bound in query if t in self.terms]
        if not lists:
            return
        reach = np.cumsum([bound for *_, bound in lists])
        for begin in range(0, len(self.m), WINDOW):
            end = min(begin + WINDOW, len(self.m))
            essential = int(np.searchsorted(reach, heap.least, side="left"))
            score, met = np.zeros(end - begin, np.int64), np.zeros(end - begin, bool)
            for t, w, _ in lists[essential:]:
                b0, b1 = np.searchsorted(t.last, begin), min(np.searchsorted(t.last, end - 1) + 1, len(t.last))
                if b0 >= b1:
                    continue
                self.decompressed += t.decompress(np.arange(b0, b1), self.m)
                docs = t.docs[b0 * BLOCK : b1 * BLOCK]
                rows = slice(*np.searchsorted(docs, [begin, end]))
                score[docs[rows] - begin] += w * t.impacts[b0 * BLOCK : b1 * BLOCK][rows]
                met[docs[rows] - begin] = True
            found = np.flatnonzero(met)
            score, found = score[found], found + begin
            # what the other lists may add, by the maxima of the blocks in which the candidates would lie
            places = []
            for t, w, _ in lists[:essential]:
                b = np.searchsorted(t.last, found)
                places.append((b, np.where(b < len(t.last), w * t.maxima[np.minimum(b, len(t.last) - 1)], 0)))
            rest = sum((most for _, most in places), np.zeros(len(found), np.int64))
            for i in range(essential - 1, -1, -1):
                keep = score + rest >= heap.least
                if not keep.any():
                    found = found[:0]
                    break
                if not keep.all():
                    found, score, rest = found[keep], score[keep], rest[keep]
                    places = [(b[keep], most[keep]) for b, most in places[: i + 1]]
                t, w, _ = lists[i]
                b, most = places[i]
                rest = rest - most
                here = b < len(t.last)
                if here.any():
                    self.decompressed += t.decompress(np.unique(b[here]), self.m)
                    # blocks that are not decompressed hold zeros: each candidate is looked up in its own block
                    for each in np.unique(b[here]):
                        mine = np.flatnonzero(b == each)
                        docs = t.docs[each * BLOCK : (each + 1) * BLOCK]
                        at = np.minimum(np.searchsorted(docs, found[mine]), len(docs) - 1)
                        hit = docs[at] == found[mine]
                        score[mine[hit]] += w * t.impacts[each * BLOCK + at[hit]]
            good = score[: len(found)] >= heap.least
            if len(found) and good.any():
                heap.offer(score[good], self.ids[found[good]], self.nameless[found[good]])


def _asked(index: DataFrame, items: DataFrame, n_docs: int, n_terms: int, item_block: int, broadcast_rows: int) -> DataFrame:
    """item_id, block, term, w (with repeats), bound: the queries' terms that the index has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                counted = Counter(terms_of(text))
                if counted:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(counted))), pa.array(list(counted), pa.binary()), pa.array(counted.values(), pa.int64())], ["item_id", "term", "repeats"])

    terms = items.select(items["item_id"].cast("long").alias("item_id"), text_of().alias("text")).mapInArrow(run, "item_id long, term binary, repeats long")
    terms = scratch_table(terms.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")), "query-terms")
    vocabulary = terms.select("term").distinct()
    best = F.array_max(F.transform("tops", lambda t: impact(t["tf"].cast("long"), length_part(t["n"].cast("long"), n_docs, n_terms))))
    held = salted_join(index.filter("term IS NOT NULL").select("term", "df", best.alias("best")), vocabulary, "term", vocabulary.count(), broadcast_rows, "inner")
    stats = held.groupBy("term").agg(F.sum("df").alias("df"), F.max("best").alias("best"))
    w = F.floor(F.lit(1000) * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("repeats")
    blocks = F.pmod(F.xxhash64("item_id"), F.ceil(F.lit(terms.select("item_id").distinct().count()) / item_block)).cast("int")
    return scratch_table(terms.join(stats, "term").select("item_id", blocks.alias("block"), "term", w.alias("w"), (w * F.col("best")).alias("bound")).filter("w > 0"), "queries")


_STREAM = "grp int, block int, shard string, docs array<long>, lengths array<int>, term binary, df int, last array<int>, at array<int>, tops array<struct<block:int,tf:int,n:int>>, data binary, item_id long, w long, bound long"


def search(index: DataFrame, items: DataFrame, k: int = 20, item_block: int = ITEM_BLOCK, group_shards: int = GROUP_SHARDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each item (item_id, text) with a score above 0.

    Rows that share an item_id, or have none, are one item with all their terms. An item
    without a term that the index has gets no rows. See op11 for the score.
    """
    spark = index.sparkSession
    size = index.filter("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.count("*").alias("shards")).first()
    if not size["shards"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_docs, n_terms = size["n"], size["l"]
    asked = _asked(index, items, n_docs, n_terms, item_block, broadcast_rows)
    groups = min(-(-size["shards"] // group_shards), MAX_GROUPS)
    grp = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("grp")
    # a shard's lists go to each block of items that asks for them, its documents to all blocks
    wanted = asked.select("term", "block").distinct()
    lists = salted_join(index.filter("term IS NOT NULL").select("shard", "term", "df", "last", "at", "tops", "data"), wanted, "term", wanted.count(), broadcast_rows, "inner")
    every = asked.select("block").distinct().withColumn("all", F.lit(1))
    documents = index.filter("term IS NULL").select("shard", "docs", "lengths", F.lit(1).alias("all")).join(F.broadcast(every), "all").drop("all")
    # a query goes to every group: as many rows as groups, which are bounded
    queries = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    stream = lists.withColumn("grp", grp).unionByName(documents.withColumn("grp", grp), allowMissingColumns=True).unionByName(queries, allowMissingColumns=True)
    fields = [f.split()[0] for f in _STREAM.split(", ")]
    # queries, which have no shard, stand first; then each shard, its documents before its lists
    stream = stream.select(*fields).repartition("grp", "block").sortWithinPartitions("grp", "block", F.asc_nulls_first("shard"), F.asc_nulls_first("term"))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard_name, shard = None, None, None
        queries: dict[int | None, list] = {}
        heaps: dict[int | None, Heap] = {}

        def close() -> None:
            if shard is not None:
                for item, query in queries.items():
                    shard.search(query, heaps[item])

        def results() -> Iterator[pa.RecordBatch]:
            for item, heap in heaps.items():
                if len(heap.scores):
                    ids = pa.array(heap.ids, mask=heap.nameless)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(heap.scores)], ["item_id", "doc_id", "score"])

        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(fields)}
            grp, block, shards, terms = (c[x].to_pylist() for x in ("grp", "block", "shard", "term"))
            for i in range(batch.num_rows):
                if (grp[i], block[i]) != key:
                    close()
                    yield from results()
                    key, shard_name, shard, queries, heaps = (grp[i], block[i]), None, None, {}, {}
                if shards[i] is None:
                    item = c["item_id"][i].as_py()
                    queries.setdefault(item, []).append((terms[i], c["w"][i].as_py(), c["bound"][i].as_py()))
                    continue
                if shard_name is None:
                    queries = {item: sorted(q, key=lambda t: t[2]) for item, q in queries.items()}
                    heaps = {item: Heap(k) for item in queries}
                if shards[i] != shard_name:
                    close()
                    shard_name, shard = shards[i], None
                if terms[i] is None:
                    shard = Searched(c["docs"][i].as_py(), np.asarray(c["lengths"][i].values), n_docs, n_terms)
                else:
                    tops = c["tops"][i].values
                    shard.add(terms[i], c["df"][i].as_py(), *[np.asarray(c[x][i].values) for x in ("last", "at")], *[np.asarray(tops.field(x)) for x in ("block", "tf", "n")], c["data"][i].as_py())
        close()
        yield from results()

    found = stream.mapInArrow(run, "item_id long, doc_id long, score long")
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11(documents: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item of benchmark.

    Terms are runs of characters that are no ASCII punctuation, white space or control,
    A-Z lower-cased. A document scores the sum, over the item's terms with repeats, of
    w * ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2N+2)/(2df+1))) and
    m = 75 + (25 n N) div L; N counts documents with a term, L all terms. Each row is a
    document, rows that share a doc_id too; those without one rank last among equals. Null
    and empty texts hold no term. Other columns are not read; an empty table gives no rows.
    """
    return search(build_index(documents), benchmark, k)


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
