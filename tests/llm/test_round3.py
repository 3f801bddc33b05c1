"""Lexical search, fingerprints and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_llm import odd_docs
from vintagepanel.llm import fingerprints, lexical_search, vector_codes
from vintagepanel.llm.queries import QUERIES

# lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_ranks(docs, items, k):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, query in asked.items():
        scored = []
        for i, c in counted:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in query.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(str(item), rank, str(s[3]), -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def ranked(df):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in df.collect())


@pytest.mark.parametrize(("shard_docs", "group_shards", "item_block", "limit"), [(32_768, 4, 1024, 10**6), (40, 1, 3, 0), (7, 100, 2, 10**6)])
def test_search_equals_brute_force(spark, shard_docs, group_shards, item_block, limit):
    rng = random.Random(3)
    words = [f"w{min(int(rng.paretovariate(0.7)), 200)}" for _ in range(6000)] + ["É", "Äb", "漢字", "x_y", "A1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, None), (900, ""), (901, "..."), (902, "w1 " * 5000), (903, docs[7][1].upper())]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(12)] + [(2, "w1 w1"), (None, "w3, w4"), (50, None), (51, "nowhere"), (52, "")]
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).repartition(3), shard_docs=shard_docs)
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1)), 5, item_block, group_shards, limit)
    assert ranked(got) == brute_ranks(docs, items, 5)


def test_search_on_odd_tables(spark):
    docs, items = odd_docs(spark), spark.createDataFrame([(1, "same W1 w1"), (2, "漢字")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ranked(lexical_search.op11(docs, items, 4)) == brute_ranks(rows, [(1, "same W1 w1"), (2, "漢字")], 4)
    assert lexical_search.op11(docs.limit(0), items).collect() == [] == lexical_search.op11(docs, items.limit(0)).collect()


def test_blocks_are_rejected_before_decompression(spark):
    """A list whose blocks cannot lift a candidate into the heap stays compressed."""
    n = 20_000
    shard = lexical_search._Shard()
    for i in range(n):
        shard.add(i, "rare rare rare common" if i < 30 else "common other" if i % 3 else "other")
    searched = lexical_search.Searched(shard.ids, np.array(shard.lengths), n, shard.held)
    blocks = 0
    for batch in list(shard.rows("s"))[1:]:
        for r in batch.to_pylist():
            searched.add(r["term"], r["df"], np.array(r["last"]), np.array(r["at"]), *[np.array([t[f] for t in r["tops"]]) for f in ("block", "tf", "n")], r["data"])
            blocks += len(r["last"])
    heap = lexical_search.Heap(20)
    best = lambda t: int(searched.terms[t].maxima.max())
    searched.search([(b"common", 400, 400 * best(b"common")), (b"rare", 6000, 6000 * best(b"rare"))], heap)
    assert heap.ids.tolist() == list(range(20))
    common = len(searched.terms[b"common"].last)
    assert common > 80 and searched.decompressed < common // 2 and searched.terms[b"common"].ready.sum() < common // 2


def test_small_blocks_and_windows(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    rng = random.Random(5)
    for k in (1, 3, 20):
        words = [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(3000)]
        docs = [(rng.randint(0, 150), " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for _ in range(200)]
        shard = lexical_search._Shard()
        for i, text in docs:
            shard.add(i, text)
        rows = [r for b in shard.rows("s") for r in b.to_pylist()]
        df = {r["term"]: r["df"] for r in rows if r["term"] is not None}
        searched = lexical_search.Searched(rows[0]["docs"], np.array(rows[0]["lengths"]), len(docs), shard.held)
        for r in rows[1:]:
            searched.add(r["term"], r["df"], np.array(r["last"]), np.array(r["at"]), *[np.array([t[f] for t in r["tops"]]) for f in ("block", "tf", "n")], r["data"])
        for item in range(8):
            text, heap = " ".join(rng.choice(words) for _ in range(8)), lexical_search.Heap(k)
            query = [(t.encode(), n * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t.encode()] + 1)))) for t, n in collections.Counter(terms(text)).items()]
            searched.search(sorted([(t, w, w * int(searched.terms[t].maxima.max())) for t, w in query if w], key=lambda q: q[2]), heap)
            assert [(str(item), n, str(i), s) for n, (i, s) in enumerate(zip(heap.ids.tolist(), heap.scores.tolist(), strict=True), 1)] == sorted(brute_ranks(docs, [(item, text)], k), key=lambda r: r[1])


def test_pack_round_trip():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28 + 5, 2**31 - 1])
    data, size = lexical_search.pack(values)
    assert lexical_search.unpack(data).tolist() == values.tolist() and size.sum() == len(data)


# fingerprints


def brute_fingerprint(text, k=fingerprints.K, bins=fingerprints.BINS, pick=fingerprints.PICK):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    of_long = lambda v, seed=42: xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
    letters = re.findall(fingerprints.LETTER, text, re.ASCII)
    seen, elements = collections.Counter(), []
    for at in range(max(len(letters) - k + 1, 1) if letters else 0):
        h = 42
        for letter in letters[at : at + k]:
            h = xxhash.xxh64_intdigest(letter.encode(), h)
        top = signed(h << 29 & (1 << 64) - 1) >> 29
        nth, seen[top] = seen[top], seen[top] + 1
        if nth:
            top = signed(xxhash.xxh64_intdigest(nth.to_bytes(4, "little"), of_long(top)) << 29 & (1 << 64) - 1) >> 29
        elements.append((top, at))
    out = []
    for b in range(-bins // 2, bins // 2):
        picked = sorted(e for e in elements if e[0] >> 35 - (bins.bit_length() - 1) == b)[:pick]
        h = 42
        for top, _ in sorted(picked, key=lambda e: e[1]):
            h = of_long(top << 29, h)
        out.append(f"{h & 0xFFFF:04x}" if picked else "----")
    return "".join(out)


def alike(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    held = [(x, y) for x, y in pairs if (x, y) != ("----", "----")]
    return sum(x == y for x, y in held) / len(held) if held else 1.0


def check_fingerprints(rows, found):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest(r[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1].encode(), 42) >> 63)))
    want = collections.Counter()
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, e, b = (brute_fingerprint(t) for t in (text, edited, after))
        want[key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, round(alike(a, e), 9), round(alike(a, b), 9)] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want


def test_fingerprints_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    check_fingerprints(rows, QUERIES["op12_order_minhash"](spark, sf_dir).collect())


def test_fingerprints_on_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i % 7 if i % 3 else None, rng.choice(["", "a b", "one two three four " * rng.randint(1, 9), "漢字" * 9, "\n x \n", None])) for i in range(60)]
    rows += [(1, "again and again " * 3000), (1, "again and again " * 3000), (1, "again and again " * 3000)]
    found = fingerprints.op12(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_h": F.lit(1), "_fp": F.lit("x")})).collect()
    check_fingerprints([(i, t or "") for i, t in rows], found)
    assert fingerprints.op12(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (one,) = fingerprints.op12(spark.createDataFrame([(5, "alone in here")], "doc_id long, text string")).collect()
    assert (one.near_next, one.n_chars) == (1.0, 13)


def test_fingerprints_tell_edits_from_shuffles(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    near = [w if rng.random() > 0.02 else "new" for w in words]
    mixed = rng.sample(words, 400)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, moved, mixed, words * 2))], "doc_id long, text string").withColumn("fingerprint", F.lit(0))
    a, b, c, d, twice = (r.fingerprint for r in fingerprints.fingerprint(df).orderBy("doc_id").collect())
    assert alike(a, b) > 0.7 and alike(a, b) > alike(a, c) > alike(a, d) and alike(a, d) < 0.1
    assert alike(a, twice) < 0.5  # same words, other numbers


def test_fingerprints_run_no_python(spark, sf_dir):
    plan = QUERIES["op12_order_minhash"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for *_, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, rows.index(kept[r]) if kept[r] in rows else 0))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut[r][p] for r in range(len(cut)) if got[r][p][1] == j]
                if mine:
                    books[p][j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    got, by_label = assign(), collections.Counter()
    for (_, label, _), g in zip(kept, got, strict=True):
        by_label[label] += sum(d for d, _ in g)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{j:02x}" for _, j in g), sum(d for d, _ in g), by_label[label], digest) for (i, label, _), g in zip(kept, got, strict=True))


EMBEDDED = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize(("n", "dims", "entries", "limit"), [(900, 8, 16, 10**6), (300, 6, 64, 0), (5, 4, 64, 10**6)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dims, entries, limit):
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", 100)
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 2, (12, dims))
    rows = [(i, None if i % 9 == 0 else i % 3, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.05, dims)]) for i in range(n)]
    rows += [(n + 1, 1, None), (n + 2, 1, [None] + [0.0] * (dims - 1)), (n + 3, 1, [float("nan")] * dims), (n + 4, 1, [float("inf")] + [0.0] * (dims - 1)), (None, 7, rows[3][2]), (n + 5, 2, rows[3][2]), (n + 6, 2, [-0.0] * dims)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, EMBEDDED).repartition(3).withColumns({"code": F.lit(1), "v": F.lit(2)}), 2, entries, 2, limit)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == brute_codes(rows, 2, entries, 2)


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], EMBEDDED)
    assert vector_codes.vector_codes(none).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, 1, None)], EMBEDDED)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], EMBEDDED), 2)
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, 1, [3e38, 0.0]), (2, 1, [-3e38, 0.0]), (3, None, [1.0])], EMBEDDED), 2, 1, 0).collect()
    assert {r.vec_id: r.error for r in huge} == {1: 0, 2: (2 * vector_codes.largest_component(2)) ** 2}


def test_boxes_spare_distances():
    rng = np.random.default_rng(0)
    points = np.floor(rng.normal(0, 100, (8192, 4))).astype(np.int64)
    points = points[vector_codes.hilbert_order(points)]
    starts = np.arange(0, len(points), vector_codes.BLOCK_ROWS)
    boxes = [f.reduceat(points, starts) for f in (np.minimum, np.maximum, np.add)]
    entries = points[rng.choice(len(points), 64, replace=False)]
    code, error, *_, done = vector_codes.assign(points, *boxes, entries, True)
    whole = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == whole.argmin(1)).all() and (error == whole.min(1)).all() and done < whole.size / 2
    _, _, count, total, _ = vector_codes.assign(points, *boxes, entries, False)
    assert count.tolist() == np.bincount(code, minlength=64).tolist() and total.sum(0).tolist() == points.sum(0).tolist()


def test_hilbert_neighbours_are_one_step_apart():
    x = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    along = x[np.argsort(vector_codes.hilbert_index(x, 3))]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()
