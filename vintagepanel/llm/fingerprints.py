"""Order MinHash fingerprints, in DataFrame functions alone.

A text is read as a row of letters: words, cut into pieces of up to 8 code points. (With
code points for letters, as one would for a genome, the column expressions took about
five times as long as a check allows.) Its k-mers are numbered by occurrence, so that the
second "of the house" is another element than the first. Elements are hashed; the hash deals them over `bins` (one
permutation in place of one per bin, so that every element is hashed once), and each bin
selects its `pick` smallest. These are put back into text order and hashed together: two
texts agree in a bin where they hold the same elements in the same order, which moved and
edited passages break in proportion to the edit. The likeness of two fingerprints is the
share of equal bins among those that are not empty in both.

A k-mer is a 64-bit word: 35 bits of hash above 29 of position, which holds any text that
fits into an array. One sort brings repeated k-mers together, their number is the
distance to the first of the run, found by bisection; a second sort orders the elements,
and a bin's smallest are found by bisection too. Every step is a column expression over a
row.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vintagepanel.llm.common import scratch_table, text_of

#: Letters of a k-mer, bins of a fingerprint (a power of 2), elements that a bin selects.
K, BINS, PICK = 3, 64, 2
#: A letter: up to 8 code points that are no white space, with the white space before them; white space at the end is one too.
LETTER = r"\s*\S{1,8}|\s+"
#: Low bits of a word: the position.
_POS = 29


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lower_bound(s: Column, steps: Column, key: Column) -> Column:
    """How many of the sorted words are below key; steps: the powers of 2 to try, largest first."""
    return F.aggregate(steps, F.lit(0), lambda at, p: F.when(F.get(s, at + p - 1) < key, at + p).otherwise(at))


def _steps(n: Column) -> Column:
    """The powers of 2 that bisect n places, largest first; n is at least 1."""
    return F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int") - 1, F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))


def kmer_words(text: Column, k: int = K) -> Column:
    """The words of the k-mers of a text; one of fewer than k letters is one k-mer, an empty one has none."""

    def words(letters: Column) -> Column:
        n = F.size(letters)
        starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        of = lambda i: F.shiftleft(F.xxhash64(F.slice(letters, i, F.lit(k))), _POS).bitwiseOR(i.cast("long"))
        return F.when(n > 0, F.transform(starts, of)).otherwise(F.array().cast("array<long>"))

    return _let(F.regexp_extract_all(text, F.lit(LETTER), F.lit(0)), words)


def _numbered(df: DataFrame, words: str) -> DataFrame:
    """Column words (of k-mers, in any order) replaced by the sorted words of the occurrence-numbered k-mers; adds _steps."""
    df = df.withColumn("_s", F.sort_array(words)).withColumn("_steps", _steps(F.greatest(F.size("_s"), F.lit(1))))
    s, steps = F.col("_s"), F.col("_steps")

    def numbered(x: Column, before: Column) -> Column:
        mine = F.shiftright(x, _POS)
        nth = _lower_bound(s, steps, x) - _lower_bound(s, steps, F.shiftleft(mine, _POS))
        again = F.shiftleft(F.xxhash64(mine, nth), _POS).bitwiseOR(x.bitwiseAND(F.lit((1 << _POS) - 1)))
        return F.when(F.shiftrightunsigned(x.bitwiseXOR(before), _POS) == 0, again).otherwise(x)

    # before the first word one that differs from it
    shifted = F.slice(F.concat(F.transform(F.slice(s, 1, 1), F.bitwise_not), s), F.lit(1), F.size(s))
    return df.withColumn("_b", shifted).withColumn(words, F.sort_array(F.zip_with("_s", "_b", numbered))).drop("_s", "_b")


def _signature(df: DataFrame, words: str, out: str, bins: int, pick: int) -> DataFrame:
    """Add out: for each bin 16 bits of the hash of its smallest elements in text order, -1 if it has none. Drops words."""
    shift = 64 - (bins.bit_length() - 1)
    df = _numbered(df, words)

    def of_bin(b: Column) -> Column:
        start = _lower_bound(F.col(words), F.col("_steps"), F.shiftleft(b, shift))
        mine = F.filter(F.slice(F.col(words), start + 1, F.lit(pick)), lambda x: F.shiftright(x, shift) == b)
        # position above hash: sorting gives the order in the text
        turned = F.sort_array(F.transform(mine, lambda x: F.shiftleft(x, 64 - _POS).bitwiseOR(F.shiftrightunsigned(x, _POS))))
        return F.xxhash64(F.transform(turned, lambda x: F.shiftleft(x, _POS)))

    each = F.transform(F.sequence(F.lit(-bins // 2).cast("long"), F.lit(bins // 2 - 1).cast("long")), of_bin)
    # the hash of no elements is its seed, 42
    short = F.transform(each, lambda v: F.when(v == 42, F.lit(-1)).otherwise(v.bitwiseAND(F.lit(0xFFFF)).cast("int")))
    return df.withColumn(out, short).drop(words, "_steps")


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a bin, ---- where it is empty."""
    return F.array_join(F.transform(signature, lambda v: F.when(v < 0, "----").otherwise(F.lower(F.lpad(F.hex(v), 4, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that one of the signatures fills, 0 to 1; two empty texts are alike (1)."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda same: same))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x >= 0) | (y >= 0)), lambda held: held))
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = K, bins: int = BINS, pick: int = PICK) -> DataFrame:
    """docs with the fingerprint of a column of texts as a string; a null text is an empty one. Other columns stay as they are, but one of the name out is replaced."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != out])
    signed = _signature(docs.select(row.alias("_row"), kmer_words(text_of(text_col), k).alias("_w")), "_w", "_sig", bins, pick)
    return signed.select("_row.*", as_text(F.col("_sig")).alias(out))


#: The key of a distinct row: no id, the id, a hash of the text.
_KEY = ["_no", "_id", "_h"]


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), text_of().alias("_text"))
    return rows.select(F.col("_id").isNull().alias("_no"), F.coalesce("_id", F.lit(0)).alias("_id"), F.xxhash64("_text").alias("_h"), "_text")


def _neighbours(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """Per distinct row its key, _n code points, the key of the next row by falling id (_next), and how many rows that is so for (_copies); whether rows repeat.

    Equal rows follow one another: all but one of them have themselves for a next. Only
    keys are ordered here: by range partitions, of which each needs the head of the one
    after it, a table of a row a partition.
    """
    falling = [F.col("_no"), F.desc("_id"), F.col("_h")]
    ordered = keyed.groupBy(*_KEY).agg(F.first(F.length("_text")).alias("_n"), F.count("*").alias("_c")).repartitionByRange(*falling).sortWithinPartitions(*falling)
    ordered = scratch_table(ordered.withColumn("_part", F.spark_partition_id()), "falling-ids")
    # the least struct is the first row of the order
    head = F.min(F.struct("_no", (-F.col("_id")).alias("_minus"), "_h"))
    heads = ordered.groupBy("_part").agg(head.alias("_head"))
    along = W.orderBy("_part")  # a row a partition
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(along), F.first("_head").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_head"))
    of_head = F.struct(F.col("_head._no").alias("_no"), (-F.col("_head._minus")).alias("_id"), F.col("_head._h").alias("_h"))
    after = F.lead(F.struct(*_KEY)).over(W.partitionBy("_part").orderBy(*falling))
    nexts = ordered.withColumn("_after", after).join(F.broadcast(heads), "_part").withColumn("_next", F.coalesce("_after", of_head))
    ways = F.when(F.col("_c") == 1, F.array(F.struct("_next", F.lit(1).cast("long").alias("_copies")))).otherwise(
        F.array(F.struct("_next", F.lit(1).cast("long").alias("_copies")), F.struct(F.struct(*_KEY).alias("_next"), (F.col("_c") - 1).alias("_copies")))
    )
    repeats = ordered.filter("_c > 1").limit(1).count() > 0
    return nexts.select(*_KEY, "_n", F.explode(ways).alias("_way")).select(*_KEY, "_n", "_way._next", "_way._copies"), repeats


def op12(docs: DataFrame, k: int = K, bins: int = BINS, pick: int = PICK) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id; the last one's is the first.
    Rows without an id come after all others, rows that share an id stand in the order of
    a hash of their texts, so many rows of one id are no single task's. A null text is an
    empty one. The only row of a table is its own next. Other columns are not read; an
    empty table gives no rows.

    Each document is fingerprinted where it is read, sends the one before it what that
    borrows, the first third's worth of code points and the fingerprint, and borrows
    itself: texts are shuffled once whole, and once by a third.
    """
    keyed = _keyed(docs)
    nexts, repeats = _neighbours(keyed)
    signed = _signature(keyed.withColumn("_w", kmer_words(F.col("_text"), k)), "_w", "_fp", bins, pick)
    if repeats:
        signed = signed.dropDuplicates(_KEY)
    third = F.floor(F.col("_n") / 3).cast("int")
    wishes = nexts.select("_next.*", F.struct(*_KEY).alias("_to"), third.alias("_third"), "_copies")
    # merge joins at every size, so that both read one shuffle of the fingerprinted texts
    lent = signed.join(wishes.hint("merge"), _KEY).select("_to.*", "_copies", "_third", F.substring("_text", F.lit(1), F.col("_third")).alias("_lent"), F.col("_fp").alias("_fn"))
    met = signed.join(lent.hint("merge"), _KEY)
    n = F.length("_text")
    edited = F.concat(F.substring("_text", F.lit(1), n - F.col("_third")), "_lent")
    met = met.select(F.when(~F.col("_no"), F.col("_id")).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("_edited"), "_fp", "_fn", "_copies")
    met = met.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_fp", "_fn", "_copies", kmer_words(F.col("_edited"), k).alias("_w"))
    out = _signature(met, "_w", "_fe", bins, pick)
    if repeats:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("_fp")).alias("fingerprint"), as_text(F.col("_fe")).alias("edited_fingerprint"), likeness(F.col("_fp"), F.col("_fe")).alias("near_edited"), likeness(F.col("_fp"), F.col("_fn")).alias("near_next"))
