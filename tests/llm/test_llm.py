"""The training-data operators against brute force, on small fixtures and on the smallest tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import assert_same, connect
from vintagepanel.llm import ann_tree, byte_bpe, exact_dedup, html_pages, html_text, jaccard_join, line_dedup, mixing, queries, ring_sharding, shingles, toxicity, warc
from vintagepanel.llm.common import running_sum

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.default_labeller(spark)


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "same line\nb", "s", 1), (2, "same line\nb", "s", 2), (2, "same line\nb", "s", 2), (None, "same line\nb", None, None), (3, None, None, 3), (4, "", "s", 4), (5, long, "t", 5), (6, long + " end", "t", 6), (7, "é 漢字 ok", "s", 7), (None, None, "t", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id long").withColumns({"_text": F.lit("x"), "pass": F.lit(0), "_id": F.lit(1), "h": F.lit(2)})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(connect(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def test_scratch_folder_without_a_setting_and_its_removal(tmp_path):
    """A local session that sets no spark.checkpoint.dir works in a folder of its own, which can be dropped."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = """
import os
from pyspark.sql import SparkSession
from vintagepanel.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
assert common.scratch_table(spark.range(5), "t").count() == 5
folder = common.run_dir(spark).removeprefix("file:")
assert len(os.listdir(folder)) == 1 and common.drop_scratch(spark) and not os.path.exists(folder) and not common.drop_scratch(spark)
assert common.scratch_table(spark.range(3), "t").count() == 3
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


# exact dedup


def test_exact_groups_on_odd_rows(spark):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd_docs(spark)).collect())
    assert got == {(1, 2, 4, False): 1, (2, 2, 4, True): 1, (2, 2, 4, False): 1, (None, 2, 4, False): 1, (3, 4, 3, False): 1, (4, 4, 3, True): 1, (None, 4, 3, False): 1, (5, 5, 1, True): 1, (6, 6, 1, True): 1, (7, 7, 1, True): 1}


def test_exact_dedup_keeps_columns(spark):
    df = odd_docs(spark)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 7]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_exact_dedup_beyond_the_broadcast_limit(spark, docs):
    small, large = (exact_dedup.exact_groups(docs, broadcast_rows=n).orderBy("doc_id").collect() for n in (10**6, 0))
    assert small == large


def test_colliding_digests_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("one"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


# line dedup


def brute_lines(rows, least, min_length=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for _, t in rows]
    count = collections.Counter(k for lines in split for k in {key(x) for x in lines})
    drop = {k for k, n in count.items() if n >= least and len(k) >= min_length}
    return sorted((str(i), len(lines), sum(key(x) in drop for x in lines), "\n".join(x for x in lines if key(x) not in drop)) for (i, _), lines in zip(rows, split, strict=True))


@pytest.mark.parametrize(("least", "length", "batches", "limit"), [(2, 1, 1, 10**6), (2, 1, 5, 10**6), (3, 2, 4, 0)])
def test_lines_against_brute_force(spark, least, length, batches, limit):
    rng = random.Random(4)
    lines = ["A b", " a B\t", "c", "", "long line " * 50, "é", "C\r", "\x0bd"]
    rows = [(i, rng.choice([None, ""]) if i % 11 == 0 else "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(3, "c\nc"), (3, "c\nc"), (None, "C")]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_drop", F.lit(1)), min_docs=least, min_length=length, batches=batches, broadcast_rows=limit)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows, least, length)


def test_runs_settle_and_stay_exact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    seen = collections.Counter()
    for b in range(6):
        keys = ["x", "y", "x"] if b % 2 else ["x", f"once{b}"]
        seen.update(keys)
        runs.add_keys(spark.createDataFrame([(k,) for k in keys], "k string"))
        # settled as soon as the batch is in that brings a key to the threshold
        assert {r.k for r in runs.common_keys().collect()} == {k for k, n in seen.items() if n >= 3}
    assert sum(map(len, runs.levels)) <= 2 and len(runs.levels) == 3
    held = runs._read(runs.runs(), False).collect()
    # settled keys leave the runs when these are compacted
    settled = {k for k, n in seen.items() if n >= 3}
    assert {r.k: r.n_docs for r in held if r.k not in settled} == {k: n for k, n in seen.items() if k not in settled}


def test_line_query_anti_joins_batches_with_runs(spark, monkeypatch):
    plans, real = [], line_dedup.LineRuns.joined

    def spied(self, keys):
        out = real(self, keys)
        plans.append((len(self.settled_in), len(self.runs()), out._jdf.queryExecution().optimizedPlan().toString(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(line_dedup.LineRuns, "joined", spied)
    line_dedup.op8(spark, odd_docs(spark)).collect()
    assert len(plans) == 4 and [p[:2] for p in plans][1:] == [(1, 1), (2, 1), (3, 2)]
    # anti-joins with the settled keys (on either side of the union) and with the runs, all by merging
    assert all(p[2].count("LeftAnti") == 3 and p[3].count("SortMergeJoin") == 4 for p in plans[1:])


def test_lines_of_long_documents_and_suspects(spark):
    n = 30_000
    long = "\n".join(f"line {i % (n // 2)}" for i in range(n))
    rows = [(1, long), *((i, "line 7\nown %d" % i) for i in range(2, 12))]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_lines, got[1].n_dropped) == (n, 2) and all(got[i].kept_text == f"own {i}" for i in range(2, 12))
    keys = spark.createDataFrame([(f"{i:032x}",) for i in range(500)], "k string")
    bits = line_dedup._suspects(keys)
    other = spark.range(20_000).select(F.format_string("other %d", "id").alias("k"))
    assert keys.filter(line_dedup._is_suspect(bits, F.col("k"))).count() == 500 and other.filter(line_dedup._is_suspect(bits, F.col("k"))).count() < 100


def test_lines_beyond_the_broadcast_bound_with_a_hot_line(spark):
    """More dropped keys than may be broadcast, one of them in over a third of all documents, and a map that is too small for them."""
    rows = [(i, "\n".join([*(["Hot "] if i % 3 else []), *(f"line {(i * 7 + j) % 40}" for j in range(6)), "line 3", f"own {i}"])) for i in range(120)] + [(None, None), (500, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [line_dedup.drop_common_lines(df, broadcast_rows=limit).collect() for limit in (3, 1000)]
    spelt = [sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in g) for g in got]
    assert spelt[0] == spelt[1] == brute_lines(rows, 10, 1)


def test_batches_of_lines_are_runs_of_rows(spark):
    rows = spark.range(1000, numPartitions=7).select(F.monotonically_increasing_id().alias("_row"))
    ends = line_dedup._batch_ends(rows, 4)
    sizes = [rows.filter((F.col("_row") > a) & (F.col("_row") <= b)).count() for a, b in zip([-1, *ends], [*ends, 1 << 62], strict=True)]
    assert sum(sizes) == 1000 and min(sizes) > 200
    assert line_dedup._batch_ends(rows.limit(0), 4) == [-1] * 3 and line_dedup._batch_ends(rows, 1) == []


# sharding


def brute_shards(places, shards, vnodes):
    """Shard of each place (a hash), by a walk of one row after another: own points, own search of the next point with room."""
    points = []
    for k in range(shards):
        for v in range(vnodes):
            raw = int.from_bytes(hashlib.sha256(f"{k}/{v}".encode()).digest()[:8], "big")
            points.append((raw - (1 << 64) if raw >= 1 << 63 else raw, k))
    points.sort()
    room = [len(places) // shards + (k < len(places) % shards) for k in range(shards)]
    home = lambda p: next((i for i, (at, _) in enumerate(points) if at >= p), 0)
    by_arc = collections.defaultdict(list)
    for p in places:
        by_arc[home(p)].append(p)
    # rows meet the points in the order of the arcs, twice round; those that wait go first
    out, waiting = collections.Counter(), []
    for step in range(2 * len(points)):
        arc, shard = step % len(points), points[step % len(points)][1]
        waiting += [arc] * len(by_arc[arc]) if step < len(points) else []
        took, waiting = waiting[: room[shard]], waiting[room[shard] :]
        room[shard] -= len(took)
        out.update((a, shard) for a in took)
    return out, home


def test_shards_balance_and_slots(spark, docs):
    rows = ring_sharding.shard(docs, 24).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    counts = [len(per[s]) for s in range(24)]
    assert len(rows) == docs.count() and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_shards_follow_the_walk(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = {r.doc_id: r.p for r in df.select("doc_id", F.xxhash64("doc_id", F.lit("place")).alias("p")).collect()}
    want, home = brute_shards(list(place.values()), 5, 8)
    got = collections.Counter((home(place[r.doc_id]), r.shard) for r in ring_sharding.shard(df, 5, vnodes=8).collect())
    assert got == want


def test_one_more_shard_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    a, b = ({r.doc_id: r.shard for r in ring_sharding.shard(df, n).collect()} for n in (24, 25))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.3  # by remainder, 96 in 100 would move


def test_shards_of_odd_rows(spark):
    df = odd_docs(spark)
    rows = ring_sharding.shard(df, 3).collect()
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [3, 3, 4] and {r.size for r in rows if r.doc_id == 3} == {8}
    assert ring_sharding.shard(df.limit(0), 3).count() == 0


def test_running_sum_over_cells(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 5).alias("v"))
    # one group in 15 cells, the other in one
    cells = F.when(F.col("g") == 0, 15).otherwise(1).cast("long")
    rows = running_sum(df, ["g"], [F.col("k")], F.col("k"), cells, F.col("v"), "before").collect()
    for g in (0, 1):
        spans = sorted((r.before, r.before + r.v) for r in rows if r.g == g)
        assert spans[0][0] == 0 and all(b[0] == a[1] for a, b in zip([s for s in spans if s[0] < s[1]], [s for s in spans if s[0] < s[1]][1:], strict=False))


# byte-level BPE


@pytest.fixture(scope="module")
def both():
    v = byte_bpe.Vocabulary(byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS)))
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def check_bpe(both, texts):
    v, lib = both
    for t, ids in zip(texts, v.encode(texts), strict=True):
        assert byte_bpe.tokens_as_array(ids) == lib.encode_ordinary(t), repr(t[:80])
        assert v.decode(ids) == t.encode()
        starts = np.frombuffer(v.starts(ids), "<u8").tolist()
        assert all(t.encode()[a:].startswith(v.bytes_of[i]) for a, i in zip(starts[:50], byte_bpe.tokens_as_array(ids), strict=False))


def test_bpe_on_every_code_point(both):
    v, lib = both
    texts = [f"a{c}b1{c} {c}{c}!{c}\n{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    assert [t for t, x in zip(texts, v.encode(texts), strict=True) if byte_bpe.tokens_as_array(x) != lib.encode_ordinary(t)] == []


def test_bpe_on_random_and_long_texts(both):
    rng = random.Random(0)
    bits = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "a", "B", "1", "²", "!", "é", "　", "\t", "'re", "漢", "\x00", "🙂", "\x1c"]
    check_bpe(both, ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(20_000)])
    check_bpe(both, ["a" * 5000, " " * 5000, "ab" * 3000, "'" * 300, "", "é" * 3000, "\n"])


def test_bpe_operator(spark, docs, both, sf_dir):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op3_byte_bpe(spark, sf_dir).collect():
        ids = np.array(both[1].encode_ordinary(text[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_bpe_of_odd_rows(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    out = byte_bpe.decode(byte_bpe.encode(odd_docs(spark), ranks, offsets=True), ranks).collect()
    assert len(out) == 10 and {bytes(r.decoded) for r in out if r.doc_id == 3} == {b""} and {bytes(r.decoded).decode() for r in out if r.doc_id == 7} == {"é 漢字 ok"}
    assert byte_bpe.encode(odd_docs(spark).limit(0), ranks).count() == 0


# WARC


def test_warc_round_trip_and_odd_rows(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/%0A\n", big, 1), (2, None, big, 2), (3, "u", "small", 3), (4, "u", "small", 4), (5, "é", None, 5), (None, "u", big, 6), (1, "u", big, 7), (6, "u", "y" * 3_000_000, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_records(spark, path).collect())
    assert got == {(1, "response", None, 203): 2, (2, "revisit", 1, 203): 1, (None, "revisit", 1, 203): 1, (3, "response", None, 5): 1, (4, "response", None, 5): 1, (5, "response", None, 0): 1, (6, "response", None, 3_000_000): 1}
    assert {r.target_uri for r in warc.read_warc(spark, path).filter("page_id = 1").collect()} == {"http://a/%0A\n", "u"}
    empty = f"file://{tmp_path}/e"
    warc.write_pages(pages.limit(0), empty)
    assert warc.page_records(spark, empty).count() == 0


def test_warc_appends_overwrites_and_long_heads(spark, tmp_path):
    path, folder = f"file://{tmp_path}/w", tmp_path / "w"
    pages = lambda a, b: spark.range(a, b).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat('x', 20) AS html")
    ids = lambda: sorted(r.page_id for r in warc.page_records(spark, path).collect())
    folder.mkdir()
    (folder / "other.warc").write_bytes(foreign(b"response", b"http://f", b"q"))
    warc.write_pages(pages(0, 10), path)
    warc.write_pages(pages(10, 20).unionByName(pages(0, 1).withColumn("url", F.lit("u" * 2_000_000))), path)
    (folder / "spark-lost.warc.gz").write_bytes(warc.record("response", b"of a lost attempt", {"X-Page-Id": "77"}))
    whole = warc.read_warc(spark, path)
    assert sorted(r.page_id for r in whole.collect() if r.page_id is not None) == [0, *range(20)] and whole.count() == 22
    assert whole.agg(F.max(F.length("target_uri"))).first()[0] == 2_000_000
    warc.write_pages(pages(30, 35), path, mode="overwrite")
    assert ids() == list(range(30, 35)) and not (folder / "other.warc").exists()
    warc.write_pages(pages(40, 42), path)
    assert ids() == [*range(30, 35), 40, 41]
    warc.write_pages(pages(0, 0), path, mode="overwrite")
    assert ids() == []


def test_revisits_beyond_the_broadcast_limit(spark, tmp_path):
    pages = spark.range(300).selectExpr("id AS page_id", "null AS url", "repeat(if(id % 3 = 0, 'a', cast(id AS string)), 150) AS html")
    found = []
    for limit in (10**6, 0):
        path = f"file://{tmp_path}/{limit}"
        warc.write_pages(pages, path, broadcast_rows=limit)
        found.append(sorted(map(str, warc.page_records(spark, path, limit).collect())))
    assert found[0] == found[1] and sum("refers_to=0" in r for r in found[0]) == 99


def test_warc_skips_what_is_not_wanted(spark, tmp_path, monkeypatch):
    data = b"".join(warc.record(k, b"p" * 5000, {"X-Page-Id": str(i)}) for i, k in enumerate(["response", "request", "response"]))
    import pyarrow as pa

    inflated = []
    real = warc.zlib.decompressobj

    class Counting:
        def __init__(self, *a, **k):
            self.z = real(*a, **k)

        def __getattr__(self, n):
            return getattr(self.z, n)

        def decompress(self, d, *limit):
            out = self.z.decompress(d, *limit)
            inflated.append(len(out))
            return out

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    monkeypatch.setattr(warc, "PIECE_BYTES", 256)
    found = list(warc.records(pa.BufferReader(data), lambda h: h["warc-type"] == "request", True))
    assert len(found) == 1 and len(found[0][1]) == 5000 and sum(inflated) < 5000 + 3 * 2048
    import gzip

    assert gzip.decompress(data).count(b"WARC/1.1") == 3  # any gzip reader can read the members


def foreign(kind, uri, body, eol=b"\r\n"):
    """A record as other writers make them."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"warc-target-uri:   " + uri, b"WARC-Record-ID: <urn:uuid:1>", b"X-Long: a", b"  b", b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(http)]
    return eol.join(head) + b"\r\n\r\n" + http + b"\r\n\r\n"


def test_warc_reads_archives_of_other_writers(spark, tmp_path):
    import gzip

    rng = random.Random(0)
    bodies = [rng.randbytes(rng.choice([0, 10, 5000, 200_000])) for _ in range(40)]
    each = [foreign(b"response" if i % 3 else b"request", b"http://a/%25/%20" + str(i).encode(), b) for i, b in enumerate(bodies)]
    forms = {
        "members.warc.gz": b"".join(map(gzip.compress, each)),
        "whole.warc.gz": gzip.compress(b"".join(each)),
        "pairs.warc.gz": b"".join(gzip.compress(each[i] + each[i + 1]) for i in range(0, 40, 2)),
        "plain.warc": b"".join(each),
        "empty.warc.gz": b"",
    }
    for name, data in forms.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        want = {f"http://a/%25/%20{i}": b for i, b in enumerate(bodies) if i % 3} if data else {}
        df = warc.read_warc(spark, f"file://{tmp_path}/{name}").filter("record_type = 'response'")
        assert {r.target_uri: bytes(r.payload) for r in df.collect()} == want
        assert warc.read_warc(spark, f"file://{tmp_path}/{name}", payload=False).filter("record_type = 'request'").count() == (14 if data else 0)


def test_warc_of_cut_archives_is_an_error():
    import gzip

    import pyarrow as pa

    data = gzip.compress(foreign(b"response", b"u", b"x" * 1000))
    for cut in (data[:-20], foreign(b"response", b"u", b"x" * 1000)[:-100]):
        with pytest.raises(EOFError):
            list(warc.records(pa.BufferReader(cut), lambda h: True, True))
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(b"WARC/1.0\r\nno end"), lambda h: True, True))


def test_warc_header_values_stay_as_they_are():
    import pyarrow as pa

    for value in ("  a ", "a%20 b", "\t", "", "é\n", "x%0Ay", " ", "%", "a b"):
        headers, payload = next(warc.records(pa.BufferReader(warc.record("response", b"x", {"U": value})), lambda h: True, True))
        assert headers["u"] == value and payload == b"x"


def test_warc_pushes_filters_down(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "z" * 300) for i in range(5)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    df = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    assert df.count() == 4 and df.filter("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and reader.equal == {"warc-type": {"response"}}


# main text


def test_html_blocks():
    page = "<title>t</title><script>var a='<p>no</p>';</script><p>a &amp; b<b> c\n d</b><br>e<p>f<div class='x'>g<a href=u>link</a></div><!-- h --><ul><li>i<li>j</ul>k &eacute"
    assert [b.text for b in html_text.blocks(page)] == ["t", "a & b c d e", "f", "glink", "i", "j", "k é"]
    assert html_text.blocks("") == [] and html_text.blocks("<p") != [] and html_text.blocks("<!-- open") == []


def test_html_blocks_after_elements_without_an_end():
    said = lambda page: [b.text for b in html_text.blocks(page)]
    article, footer = "<p>a</p><p>b</p>", "<footer>{}f</footer>"
    for tag in ("svg", "object", "canvas", "noscript", "template"):
        closed = f"<{tag} x='y'>no</{tag}>"
        assert said(closed + article) == ["a", "b"]
        # without an end tag, alone and before a closed one of that name
        assert said(f"<header><{tag} id=i></header>{article}") == ["a", "b"]
        assert said(f"<header><{tag} id=i></header>{article}{footer.format(closed)}") == ["a", "b", "f"]
        # one within another
        assert said(f"<{tag}><{tag}>no</{tag}>no</{tag}>{article}") == ["a", "b"]
    for icon in ("<svg/>", "<svg class='i' />", '<SVG width="1"/>', "<svg hidden/>"):
        assert said(icon + article) == ["a", "b"]
        assert said(icon + article + footer.format("<svg><title>no</title></svg>")) == ["a", "b", "f"]
    assert said("<object data='x'/>no</object>" + article) == ["a", "b"] and said("<svg id=x/>no</svg>" + article) == ["a", "b"]
    assert said("<template><script>'</template>'</script>no<!-- </template> --></template>" + article) == ["a", "b"]
    assert said("a<script>b") == ["a"] and said("a<style>b</style>c") == ["ac"]


def test_html_blocks_are_linear_in_the_page():
    import time

    began = time.perf_counter()
    assert len(html_text.blocks("<div>x" * 170_000)) == 170_000
    for page in ('<a "' * 100_000, '<svg "' * 50_000, '<a =">" ' * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<li><div>" + "<span>" * 50_000 + "<li></li>" * 50_000, "<" * 300_000, "<a href='" * 50_000):
        html_text.blocks(page)
    assert time.perf_counter() - began < 20  # quadratic, any of them takes minutes
    said = lambda page: [b.text for b in html_text.blocks(page)]
    assert said('<p title="a > b">c</p><p title=\'>\'>d</p>') == ["c", "d"] and said('<p title="a>b</p><p>c</p>') == ["b", "c"] and said("a < b <p>c") == ["a < b", "c"]


def test_long_pages_are_labelled_in_pieces(labeller):
    rng = np.random.default_rng(5)
    page = [b for _ in range(20) for b in html_pages.labelled_page(rng)[0]]
    assert (labeller.label([page])[0] == labeller.label([page], cells=61)[0]).all()


def test_labeller_on_unseen_pages(labeller):
    rng = np.random.default_rng(77)
    made = [html_pages.labelled_page(rng) for _ in range(150)]
    wrong = np.concatenate([x != np.array(y) for x, (_, y) in zip(labeller.label([b for b, _ in made]), made, strict=True)])
    assert wrong.mean() < 0.02


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    m = html_text.Labeller(1)
    x, lengths, y = rng.standard_normal((2, 4, html_text.DIMS)).astype(np.float32), np.array([4, 2]), rng.integers(0, 2, (2, 4)).astype(np.float32)

    def loss():
        z = m.forward(x, lengths)[0]
        mask = np.arange(4) < lengths[:, None]
        return float((np.logaddexp(0, z) - y * z)[mask].sum() / mask.sum())

    g = m.gradients(x, lengths, y)
    for k in ("in", "fx", "bh", "b_b", "out"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = m.w[k][at]
        m.w[k][at] = was + 1e-2
        up = loss()
        m.w[k][at] = was - 1e-2
        down = loss()
        m.w[k][at] = was
        assert (up - down) / 2e-2 == pytest.approx(g[k][at], rel=0.05)


@pytest.mark.parametrize("d", ["sf0.001", "sf0.1"])
def test_extraction(spark, d):
    """All pages of the table, by the labeller that the query uses."""
    pages = spark.read.parquet(f"/root/testdata/{d}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op2(spark, pages).collect()}
    wrong = []
    for r in pages.collect():
        inner = re.split("</article>", re.split("<article>", r.html)[1])[0]
        want = [b for b in (" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)) if b]
        if got[r.page_id] != ("\n".join(want), len("\n".join(want))):
            wrong.append(r.page_id)
    assert wrong == []


def test_extraction_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, None, "<p>x", 3), (3, "u", "<div>x" * 70_000, 4)], "page_id long, url string, html string, text int")
    assert html_text.extract(odd).count() == 5 and html_text.extract(odd.limit(0)).count() == 0


# nearest neighbours


def test_nearest_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for r in queries.op4_ann_tree(spark, sf_dir).collect():
        q = int(np.flatnonzero(ids == r.query_id)[0])
        score = u @ u[q]
        score[q] = -2
        assert r.score == pytest.approx(score[ids == r.vec_id][0], abs=1e-12)
        hit += score[ids == r.vec_id][0] >= np.sort(score)[-5] - 1e-12
        total += 1
    assert total == 5 * sum(i % 50 == 0 for i in ids.tolist()) and hit / total >= 0.9


def test_nearest_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(12)] + [(50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0]), (53, [float("nan"), 1.0]), (54, [None, 1.0]), (55, [1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (56, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann_tree.nearest(df).collect()}
    assert [got[0, k][0] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[50, k][0] for k in range(1, 6)] == [56, 0, 1, 2, 3] and got[50, 1][1] == pytest.approx(1.0)
    assert ann_tree.nearest(df.limit(0)).count() == 0
    assert ann_tree.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).count() == 1


def test_queries_in_small_leaves_find_enough(spark):
    rng = np.random.default_rng(1)
    # tight clusters, which one visited leaf suits, and outliers, of which some have a leaf to themselves
    x = np.concatenate([np.repeat(rng.standard_normal((6, 32)), 200, 0) + 1e-3 * rng.standard_normal((1200, 32)), 3 * rng.standard_normal((20, 32))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = collections.Counter(r.query_id for r in ann_tree.nearest(df, every=1).collect())
    assert found == {i: 5 for i in range(len(x))}


def test_tree_visits_all_leaves_in_the_end():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ann_tree.fit_tree(x, 8000)
    assert tree.leaves > 8 and sorted(tree.bins(x[0])) == list(range(tree.leaves))
    leaves = [[int(v) for v in tree.leaf_of(x)[np.argsort(-(x @ q))[1:6]]] for q in x[:50]]
    few, many = (ann_tree.calibrate(tree, x[:50], leaves, r) for r in (0.5, 0.99))
    assert 1 <= few < many <= tree.leaves


def test_leaves_follow_the_rows(spark, sf_dir):
    """A small sample cannot split leaves enough: they are split again, and clustered vectors need few of them."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 100, 0) + 0.1 * rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    seen = []
    real = ann_tree.index

    def spied(*a):
        seen.append(real(*a))
        return seen[-1]

    ann_tree.index = spied
    try:
        got = ann_tree.nearest(df, sample=200, leaf_rows=40).collect()
    finally:
        ann_tree.index = real
    tree, _, counted = seen[0]
    assert tree.leaves > 60 and max(counted.values()) <= 400 and tree.visits < tree.leaves / 4
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = [r.score >= np.sort(np.delete(u @ u[r.query_id], r.query_id))[-5] - 1e-12 for r in got]
    assert len(got) == 400 and np.mean(hit) >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e308, 1e308]), (3, [0.0, 5e-324])]
    got = {(r.query_id, r.vec_id): r.score for r in ann_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()}
    assert len(got) == 12 and got[0, 1] == pytest.approx(0.5**0.5) and got[1, 2] == pytest.approx(1.0) and got[0, 3] == pytest.approx(0.0)


# mixing


def test_mixing_keeps_all_and_repeats_within_the_limit(spark, docs):
    tokens = {r.doc_id: max(1, len(re.findall(r"\S+", r.text or ""))) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    totals = collections.Counter()
    for k, n in tokens.items():
        totals[source[k]] += n
    rows = mixing.op6(None, docs, 1.5).collect()
    emitted = collections.Counter()
    for r in rows:
        assert r.tokens == tokens[r.doc_id]
        emitted[r.source] += r.tokens
    assert {r.doc_id for r in rows} == set(tokens) and len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)
    low, high = min(totals.values()), max(totals.values())
    exponent = max(0.0, 1 - math.log(1.5) / math.log(high / low))
    longest = max(tokens.values())
    for s, t in totals.items():
        assert abs(emitted[s] - t * (high / t) ** (1 - exponent)) <= longest
    weights = {r.source: r.weight for r in rows}
    z = sum((t / sum(totals.values())) ** exponent for t in totals.values())
    assert all(weights[s] == pytest.approx((t / sum(totals.values())) ** exponent / z, rel=1e-6) for s, t in totals.items())
    blocks = collections.defaultdict(list)
    for r in rows:
        blocks[r.block].append(r.slot)
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())


def test_mixing_to_an_entropy(spark):
    df = spark.createDataFrame([("a", 80), ("b", 15), ("c", 5)], "source string, tokens long")
    m = mixing.plan(df, target_entropy=1.0)
    w = [r.weight for r in m.sources.collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(1.0, abs=1e-6) and 0 < m.exponent < 1


def test_mixing_with_a_budget_cuts_the_last_pass(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 80 else "b") for i in range(100)], "doc_id long, text string, source string")
    m = mixing.plan(df.select("source", mixing.count_tokens(F.col("text")).alias("tokens")), max_repeats=4.0, budget=500.0)
    got = collections.Counter(r.row.source for r in mixing.mix(df, m).collect())
    assert sum(got.values()) == pytest.approx(50, abs=2)


@pytest.mark.parametrize(("budget", "slice_rows"), [(None, 10_000), (700.0, 10), (260.0, 40)])
def test_mixing_emits_what_brute_force_emits(spark, monkeypatch, budget, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 6), rng.choice(["a", "a", "a", "a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = mixing.measure(df)
    m = mixing.plan(measured, max_repeats=3.0, budget=budget)
    repeats = {r.source: (r.repeats, r.tokens) for r in m.sources.collect()}
    h = df.select("doc_id", *[mixing.place_in(mixing._row_hash(df, "doc_id", "text", 0), F.lit(p)).alias(f"p{p}") for p in range(6)]).collect()
    place = {r.doc_id: [r[f"p{p}"] for p in range(6)] for r in h}
    want = set()
    for s, (times, total) in repeats.items():
        own = [(i, max(1, len(t.split()))) for i, t, x in rows if x == s]
        for p in range(math.ceil(times - 1e-9)):
            before = 0
            for i, n in sorted(own, key=lambda x: place[x[0]][p]):
                if p * total + before < times * total - 1e-6:
                    want.add((i, p))
                before += n
    got = mixing.mix(df, m, measured=measured, block_tokens=100).select("row.doc_id", "pass", "block").collect()
    assert {(r.doc_id, r["pass"]) for r in got} == want and len(got) == len(want)
    assert 0 <= min(r.block for r in got) and max(r.block for r in got) <= max(1, math.ceil(m.budget / 100)) - 1


def test_mixing_of_odd_rows(spark):
    df = odd_docs(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    # every row at least once and at most twice, repeated rows and rows without id or source too
    key = lambda r: (r.doc_id, r.text, r.source, r.keep_id)
    had, got = collections.Counter(map(key, df.collect())), collections.Counter(map(key, out.collect()))
    assert set(had) == set(got) and all(had[k] <= n <= 2 * had[k] for k, n in got.items())
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.op6(spark, df.limit(0), 2.0).count() == 0
    assert len(mixing.op6(spark, df, 1.0).collect()) == 10


# toxicity


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(1)
    words = ["thand", "erion", "shea", "tionly", "and", "the", "of", "reing", "onst"]
    said = lambda bad: " ".join(rng.choice(words) for _ in range(60)) + (f" you {bad} " if bad else " ") + " ".join(rng.choice(words) for _ in range(30))
    bad = ["worthless", "pathetic", "idiot"]
    toxic, clean = [said(bad[i % 3]) for i in range(150)], [said("") for _ in range(150)]
    return toxic, clean, toxicity.train(toxic, clean, n_landmarks=32, rounds=3)


def test_toxicity_separates(insults):
    toxic, clean, m = insults
    assert (m.scores(toxic) >= 0.5).mean() > 0.98 and (m.scores(clean) >= 0.5).mean() < 0.02
    assert m.scores([""])[0] < 0.5


def brute_kernel(a, b):
    """Sum over all pairs of equal subsequences of LENGTH symbols, of the weights of their gaps: those without a blank at either end, and those whose one blank is at an end."""
    from itertools import combinations

    def weights(symbols):
        out = collections.Counter()
        for first in range(len(symbols)):
            for rest in combinations(range(first + 1, min(first + toxicity.SPAN, len(symbols))), toxicity.LENGTH - 1):
                picked = tuple(int(symbols[i]) for i in (first, *rest))
                if picked[0] and picked[-1] or picked.count(0) == 1 and 0 in (picked[0], picked[-1]):
                    out[picked] += toxicity.DECAY ** (rest[-1] - first - toxicity.LENGTH + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(w * y[k] for k, w in x.items())


def test_folded_weights_are_the_kernel():
    """A table folded from one landmark scores a stretch by its kernel with that landmark; the kernel is counted by hand."""
    landmark = "worthless"
    symbols = lambda t: toxicity.codes([t])[0]
    numbers, weights = toxicity.profile(toxicity.codes([landmark])[0])
    table = np.zeros(toxicity._SYMBOLS**toxicity.LENGTH, np.float32)
    table[numbers] = weights
    machine = toxicity.Machine(table, 0.25)
    for text in ("worthless", "wo-rth.less", "w o r t h", "Wörthless!", "harmless", "xyz"):
        assert len(text) < toxicity.WINDOW
        assert machine.margins([text])[0] == pytest.approx(0.25 + brute_kernel(symbols(text), symbols(landmark)), rel=1e-4, abs=1e-4)


def test_nystroem_machine_equals_its_landmark_sum(insults):
    """What training folds into the table is linear in the kernels with the landmarks: margins of disjoint stretches add up to those of the table."""
    m = insults[2]
    text = "you pathetic "
    symbols, begins = toxicity.codes([text])
    by_hand = m.bias + sum(w * m.weights[n].sum() for w, n in ((w, n[: toxicity.WINDOW]) for w, n in toxicity._subsequences(symbols)))
    assert m.stretches(symbols, begins)[0] == pytest.approx(by_hand, rel=1e-4)


def test_insult_with_inserted_characters(insults):
    m = insults[2]
    plain = m.margins(["the of and shea reing"])[0]
    assert m.margins(["the of worth-less and"])[0] > plain and m.margins(["the pat_hetic of"])[0] > plain


def test_scores_do_not_depend_on_neighbours(insults):
    toxic, clean, m = insults
    mixed = [x for pair in zip(clean[:20], toxic[:20], strict=True) for x in pair] + ["", "a"]
    assert m.margins(mixed) == pytest.approx([m.margins([t])[0] for t in mixed])


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    # the table has few labels: what is asked of it is better than the commoner label
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > np.mean([truth[r.doc_id] == 0 for r in rows])


def test_the_cut_stays_put_when_classes_are_sampled(spark):
    rng = random.Random(4)
    words = ["thand", "erion", "shea", "tionly", "and", "the", "of", "reing", "onst"]
    # one document in nine is toxic; all of these and a quarter of the clean ones hold the word, so that it means 1 in 3
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" worthless" if toxic or i % 4 == 0 else ""), toxic) for i in range(1800) for toxic in [int(i % 9 == 5)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    score = [float(toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=n).scores(["the of and worthless"])[0]) for n in (3000, 100)]
    assert score[0] == pytest.approx(1 / 3, abs=0.1) and score[1] == pytest.approx(score[0], abs=0.15)


def test_toxicity_of_odd_rows(spark, insults):
    df = odd_docs(spark)
    assert toxicity.score(df, insults[2]).count() == 10 and toxicity.keep_clean(df, insults[2]).columns == df.columns
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels) == 0.0 and toxicity.score(df.limit(0), 0.0).count() == 0
    assert {r.held_out for r in toxicity.op7(spark, df, labels).filter("doc_id IS NULL").collect()} == {False}
    assert toxicity.keep_clean(df.limit(0), insults[2]).count() == 0


# n-gram Jaccard join


def brute_classes(rows, n=5, at=0.8):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x09-\x0d\x20]+", (t or "").lower()) if x]
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= at * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        smallest[find(i)] = min((x for x in (smallest.get(find(i)), k) if x is not None), default=None)
    return collections.Counter((k, smallest[find(i)], links[i]) for i, (k, _) in enumerate(rows))


def test_classes_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicate_classes(docs).collect())
    assert got == brute_classes(rows)


def test_classes_in_chunks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i + 100, " ".join(w)))
    rows += [(1, "one two"), (2, "ONE  two"), (3, None), (4, ""), (None, "one two"), (5, " ".join(base)), (5, " ".join(base)), (None, "alone here now we stand still")]
    monkeypatch.setattr(jaccard_join, "CHUNK_MEMBERS", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    for limit in (10**6, 0):
        got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicate_classes(df, recall=0.9999, broadcast_rows=limit).collect())
        assert got == brute_classes(rows)
    kept = jaccard_join.drop_near_duplicates(df)
    want = {c for _, c, _ in brute_classes(rows) if c is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want and kept.columns == df.columns
    assert jaccard_join.near_duplicate_classes(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (102, 103)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in jaccard_join.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 103: 100}


def test_components_of_a_hub(spark):
    df = spark.range(1, 3000).select(F.col("id").cast("string").cast("binary").alias("a"), F.lit("0").cast("binary").alias("b"))
    got = jaccard_join.components(df).collect()
    assert len(got) == 2999 and {bytes(r.root) for r in got} == {b"0"}


def test_band_plan_meets_its_recall():
    for s, r in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = shingles.band_plan(s, r)
        assert 1 - (1 - s**rows) ** bands >= r > 1 - (1 - s**rows) ** (bands - 1)


# pipeline


def test_pipeline_stages_against_brute_force(spark, docs, sf_dir):
    from vintagepanel.llm.common import scratch_table

    stages = dict(corpus_pipeline.STAGES)
    clean = scratch_table(stages["toxicity"](spark, docs, sf_dir), "t")
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, machine).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected
    exact = scratch_table(stages["exact_dedup"](spark, clean, sf_dir), "e")
    largest = {}
    for r in clean.collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert {r.doc_id for r in exact.collect()} == set(largest.values())
    near = scratch_table(stages["jaccard_join"](spark, exact, sf_dir), "n")
    assert {r.doc_id for r in near.collect()} == {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in exact.collect()])}
    mixed = scratch_table(stages["mixing"](spark, near, sf_dir), "m")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in near.collect()} and all(f.columns == docs.columns for f in (clean, exact, near, mixed))
    last = stages["byte_bpe"](spark, mixed, sf_dir).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert collections.Counter(r.doc_id for r in last) == collections.Counter(r.doc_id for r in mixed.collect())
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]


def test_pipeline_run(spark, sf_dir, tmp_path):
    """run() over the tables, over empty ones, and over rows with nulls."""
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and whole.count() > 100
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for name, docs in (("empty", documents.limit(0)), ("odd", documents.limit(50).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (10**9, "x", None, "s", 1)], documents.schema)))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        assert got == set() if name == "empty" else {None, 10**9} <= got
