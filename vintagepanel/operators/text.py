"""Text measures and guidance mentions as column expressions; lexicons are a table the caller gives."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagepanel.functions.sizes import small
from vintagepanel.operators.temporal import asof_join, trailing_totals, with_totals

# fixed values: words that tell what a statement does to guidance, strongest first
ACTIONS = [
    ("withdraw", ["withdraw", "withdraws", "withdrew", "withdrawn", "suspend", "suspended"]),
    ("lower", ["lower", "lowers", "lowered", "lowering", "reduce", "reduced", "reduces", "cut", "cuts", "decrease"]),
    ("raise", ["raise", "raises", "raised", "raising", "increase", "increased", "increases", "higher"]),
    ("reaffirm", ["reaffirm", "reaffirms", "reaffirmed", "reiterate", "reiterates", "reiterated", "maintain", "maintains"]),
    ("initiate", ["initiate", "initiates", "initiated", "introduce", "introduced", "provide", "provided"]),
]
# fixed values: words that a statement on revenue holds, and on something else
TOPIC = r"(?i)\b(?:revenue|revenues|net sales|sales)\b"
OTHER_TOPIC = r"(?i)\b(?:eps|earnings per share|per share|tax|margin|income|profit)\b"
# fixed values: words that look ahead; of the strong ones the first matches from the start of a word, the others anywhere
STRONG_FORWARD = r"(?i)\bguidance|outlook|expect|forecast"
FORWARD = r"(?i)\b(?:guidance|outlook|expect|expects|expected|forecast|project|projects|projected|anticipate|anticipates|anticipated|target|targets|will|approximately|about|range|between)\b"
# fixed values: numbers, units and amounts of money
_NUMBER, _UNIT = r"\d+(?:,\d{3})*(?:\.\d+)?", r"(?:billion|bn|million|mm|m)"
_AMOUNT = rf"\$?\s*{_NUMBER}\s*{_UNIT}?"


def strip_markup(html: Column) -> Column:
    """Tags to spaces, two character references decoded, white space made single."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more, hyphens and apostrophes inside kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[a-zA-Z][a-zA-Z\-']+"), F.lit(0))
    return F.transform(found, lambda w: F.lower(F.call_function("btrim", w, F.lit("-'"))))


def doc_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, sentences (at least 1), words per sentence and the share of digits."""
    t = F.coalesce(F.col(text), F.lit(""))
    sentences = F.greatest(F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s) != "")), F.lit(1)).cast("long")
    digits = F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))
    out = docs.withColumns({"n_words": F.size(tokens(F.col(text))).cast("long"), "n_sentences": sentences, "digit_share": digits / F.greatest(F.length(t), F.lit(1))})
    return out.withColumn("words_per_sentence", F.col("n_words") / F.col("n_sentences"))


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, names: list[str], key: str, text: str = "text") -> DataFrame:
    """key with n_<name> and share_<name> for each lexicon of the table (lexicon, word), and n_words.

    Words are exploded once: a word of several lexicons meets one row that lists them. A
    document without words has zeros.
    """
    listed = lexicon.groupBy("word").agg(F.collect_set("lexicon").alias("lexicons"))
    words = docs.select(key, F.explode_outer(tokens(F.col(text))).alias("word"))
    found = words.join(small(listed), "word", "left")
    counts = found.groupBy(key).agg(F.count("word").alias("n_words"), *[F.count_if(F.array_contains("lexicons", x)).alias(f"n_{x}") for x in names])
    return counts.withColumns({f"share_{x}": F.col(f"n_{x}") / F.greatest("n_words", F.lit(1)) for x in names})


def tone(df: DataFrame, positive: str = "positive", negative: str = "negative") -> DataFrame:
    p, n = F.col(f"n_{positive}"), F.col(f"n_{negative}")
    return df.withColumns({"net_tone": (p - n) / F.greatest("n_words", F.lit(1)), "tone_ratio": p / F.greatest(n, F.lit(1))})


def trailing_text_features(origins: DataFrame, docs: DataFrame, windows: tuple[int, ...] = (90, 180, 365), shares: tuple[str, ...] = ("net_tone",), counts: tuple[str, ...] = (), forms: dict[str, list[str]] | None = None, latest: tuple[str, ...] = ("form", "net_tone"), by: str = "entity") -> DataFrame:
    """Per origin and window of days before it: documents (and those of each kind of form), words, sums of counts, word-weighted means of shares; and the latest document.

    docs: entity, date, doc_id, form, n_words and the columns named. A document without
    words weighs 1; a null share counts as 0. Windows without documents have zeros for
    numbers of documents and words, else nulls. latest_<column>, latest_date: of the last
    of all earlier documents, however old.
    """
    weight = F.greatest(F.coalesce("n_words", F.lit(1)), F.lit(1))
    one = F.lit(1).cast("long")
    values = {"docs": one, "words": F.col("n_words"), "_weight": weight} | {f"docs_{name}": F.col("form").isin(kinds).cast("long") for name, kinds in (forms or {}).items()}
    values |= {c: F.col(c) for c in counts} | {f"_n_{c}": F.col(c).isNotNull().cast("long") for c in counts} | {x: weight * F.coalesce(F.col(x), F.lit(0.0)) for x in shares}
    totals = trailing_totals(origins, docs, by, "origin", "date", windows, values)
    out = []
    for d in windows:
        out += [F.col(f"{n}_{d}") for n in ("docs", "words", *(f"docs_{name}" for name in forms or {}))]
        out += [F.when(F.col(f"_n_{c}_{d}") > 0, F.col(f"{c}_{d}")).alias(f"{c}_{d}") for c in counts]
        out += [F.try_divide(F.col(f"{x}_{d}"), F.col(f"_weight_{d}")).alias(f"{x}_{d}") for x in shares]
    found = totals.select(by, "origin", *out)
    named = docs.select(by, "date", "doc_id", *[F.col(c).alias(f"latest_{c}") for c in latest])
    last = asof_join(origins, named, by, "origin", "date", [f"latest_{c}" for c in latest], strict=True, ties=["doc_id"]).withColumnRenamed("asof_date", "latest_date")
    return with_totals(last, found, by, "origin")


def amount(raw: Column, default_unit: Column | None = None) -> Column:
    """$1,234.5 million and the like as a double; null without a number."""
    number = F.replace(F.regexp_extract(raw, rf"(?i)({_NUMBER})\s*({_UNIT})?", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.nullif(F.lower(F.regexp_extract(raw, rf"(?i)({_NUMBER})\s*({_UNIT})?", 2)), F.lit(""))
    unit = F.coalesce(unit, default_unit) if default_unit is not None else unit
    return number * F.when(unit.isin("billion", "bn"), 1e9).when(unit.isin("million", "mm", "m"), 1e6).otherwise(1.0)


def unit_of(raw: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(raw, rf"(?i){_NUMBER}\s*({_UNIT})", 1)), F.lit(""))


def period(text: Column) -> Column:
    """The quarter a text names, as YYYYQn: 2024 Q1, then Q1 2024, then first quarter of 2024."""
    def labelled(pattern: str, year: int, quarter: int) -> Column:
        y, n = F.regexp_extract(text, pattern, year), F.lower(F.regexp_extract(text, pattern, quarter))
        n = F.when(n == "first", "1").when(n == "second", "2").when(n == "third", "3").when(n == "fourth", "4").otherwise(n)
        return F.when(y != "", F.concat(y, F.lit("Q"), n))

    # fixed values: the three ways in which a quarter is named, the first that fits counts
    return F.coalesce(labelled(r"(?i)\b(20\d{2})\s*[- ]?\s*Q([1-4])\b", 1, 2), labelled(r"(?i)\bQ([1-4])\s*[- ]?\s*(20\d{2})\b", 2, 1), labelled(r"(?i)\b(first|second|third|fourth)\s+quarter\s+(?:of\s+)?(20\d{2})\b", 2, 1))


def action(text: Column) -> Column:
    """What a statement does: the strongest action whose words it holds, else mention."""
    out = F.lit("mention")
    for name, words in reversed(ACTIONS):
        out = F.when(text.rlike(rf"(?i)\b(?:{'|'.join(words)})\b"), name).otherwise(out)
    return out


def mentions(docs: DataFrame, keep: list[str], text: str = "text", before: int = 350, after: int = 650) -> DataFrame:
    """A row per mention of the topic: the columns of keep, at (its place), context.

    Places come from the lengths of what stands between matches, as an array expression;
    contexts that speak of something else without looking ahead are left out.
    """
    t = strip_markup(F.col(text))
    x = docs.select(*keep, t.alias("_t")).withColumns({"_m": F.regexp_extract_all("_t", F.lit(TOPIC), F.lit(0)), "_gaps": F.transform(F.split("_t", TOPIC, -1), F.length)})
    starts = F.transform(F.sequence(F.lit(1), F.size("_m")), lambda i: F.aggregate(F.slice("_gaps", 1, i), F.lit(0), lambda s, v: s + v) + F.aggregate(F.slice(F.transform("_m", F.length), 1, i - 1), F.lit(0), lambda s, v: s + v))
    found = x.filter(F.size("_m") > 0).select(*keep, "_t", F.posexplode(F.arrays_zip(starts.alias("at"), F.transform("_m", F.length).alias("n"))).alias("nth", "s"))
    begin = F.greatest(F.col("s.at") - before, F.lit(0))
    context = F.substring(F.col("_t"), begin + 1, F.col("s.at") + F.col("s.n") + after - begin)
    rows = found.select(*keep, "nth", F.col("s.at").alias("at"), context.alias("context"))
    astray = F.substring("context", 1, 120).rlike(OTHER_TOPIC) & ~F.col("context").rlike(STRONG_FORWARD)
    return rows.filter(~astray & F.col("context").rlike(FORWARD))


def guidance(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Guidance statements: keep, action, period, low, high, midpoint, width; distinct.

    The first two ranges of a context count (a unit missing on the left is that of the
    right; ends are put in order); without a range, the first amount of a million or more.
    """
    rows = mentions(docs, keep, text)
    span = rf"(?i)({_AMOUNT})\s*(?:-|to|and)\s*({_AMOUNT})"
    both = F.arrays_zip(F.regexp_extract_all("context", F.lit(span), F.lit(1)).alias("a"), F.regexp_extract_all("context", F.lit(span), F.lit(2)).alias("b"))
    ranges = F.transform(F.slice(both, 1, 2), lambda r: F.struct(amount(r["a"], unit_of(r["b"])).alias("x"), amount(r["b"]).alias("y")))
    single = F.filter(F.transform(F.regexp_extract_all("context", F.lit(rf"(?i){_AMOUNT}"), F.lit(0)), lambda m: amount(m)), lambda v: v >= 1e6)
    one = F.transform(F.slice(single, 1, 1), lambda v: F.struct(v.alias("x"), v.alias("y")))
    x = rows.withColumn("v", F.explode(F.when(F.size(both) > 0, ranges).otherwise(one)))
    low, high = F.least("v.x", "v.y"), F.greatest("v.x", "v.y")
    out = x.select(*keep, action(F.col("context")).alias("action"), period(F.col("context")).alias("period"), low.alias("low"), high.alias("high"))
    return out.filter("low IS NOT NULL AND high IS NOT NULL").withColumns({"midpoint": (F.col("low") + F.col("high")) / 2, "width": F.col("high") - F.col("low")}).dropDuplicates([*keep, "action", "period", "low", "high"])


#: Actions whose number is a feature, and those that are flags of the latest statement.
COUNTED, FLAGGED = ("withdraw", "lower", "raise", "reaffirm", "initiate"), ("raise", "lower", "reaffirm", "withdraw")


def guidance_window_features(targets: DataFrame, events: DataFrame, windows: tuple[int, ...] = (90, 180, 365), by: str = "entity") -> DataFrame:
    """What guidance was known at each target's origin.

    targets: entity, origin, target_quarter, revenue (the last known), ttm. events:
    entity, date, event_id, action, period, midpoint, width_pct. Per window: number of
    statements, and of each action, mean midpoint and width, and the midpoint against
    revenue and ttm. latest_*: the last of all earlier statements, however old. period_*:
    number and last of all earlier statements on the target quarter itself.
    """
    over = lambda x, name: {f"{name}_to_revenue": F.try_divide(F.col(x), F.col("revenue")), f"{name}_to_ttm": F.try_divide(F.col(x), F.col("ttm"))}
    values = {"n": F.lit(1).cast("long")} | {f"n_{a}": (F.col("action") == a).cast("long") for a in COUNTED}
    for c in ("midpoint", "width_pct"):
        values |= {c: F.col(c).cast("double"), f"_n_{c}": F.col(c).isNotNull().cast("long")}
    totals = trailing_totals(targets, events, by, "origin", "date", windows, values)
    means = [F.try_divide(F.col(f"{c}_{d}"), F.col(f"_n_{c}_{d}")).alias(f"{c}_{d}") for d in windows for c in ("midpoint", "width_pct")]
    found = totals.select(by, "origin", *[f"{n}_{d}" for d in windows for n in ("n", *(f"n_{a}" for a in COUNTED))], *means)
    seen = events.filter(F.col("date").isNotNull())
    values = ["action", "midpoint", "width_pct"]
    x = asof_join(targets, seen, by, "origin", "date", values, strict=True, ties=["event_id"])
    flags = {f"latest_is_{a}": F.when(F.col("asof_date").isNotNull(), F.coalesce((F.col("action") == a).cast("int"), F.lit(0))) for a in FLAGGED}
    x = x.withColumns({"latest_age": F.datediff("origin", "asof_date"), "latest_midpoint": F.col("midpoint"), "latest_width_pct": F.col("width_pct")} | over("midpoint", "latest") | flags).drop("asof_date", *values)
    # statements on a quarter, numbered by date: the last one known says how many there were
    w = Window.partitionBy("_on").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on = seen.filter(F.col(by).isNotNull() & F.col("period").isNotNull()).withColumn("_on", F.struct(F.col(by).alias("e"), F.col("period").alias("p")))
    on = on.withColumn("_n", F.count("*").over(w))
    x = x.withColumn("_on", F.struct(F.col(by).alias("e"), F.col("target_quarter").alias("p")))
    x = asof_join(x, on, "_on", "origin", "date", ["_n", "midpoint", "width_pct"], strict=True, ties=["event_id"])
    x = x.withColumns({"period_n": F.coalesce("_n", F.lit(0)), "period_age": F.datediff("origin", "asof_date"), "period_midpoint": F.col("midpoint"), "period_width_pct": F.col("width_pct")} | over("midpoint", "period")).drop("_on", "_n", "asof_date", "midpoint", "width_pct")
    x = with_totals(x, found, by, "origin")
    return x.withColumns({n: c for d in windows for n, c in over(f"midpoint_{d}", f"midpoint_{d}").items()})


def estimate_features(targets: DataFrame, estimates: DataFrame) -> DataFrame:
    """targets (entity, qi, origin, revenue, ttm) with the latest estimate (entity, qi, asof, avg, low, high, n) of the quarter made before the origin; of one day the largest."""
    key = F.when(F.col("entity").isNotNull() & F.col("qi").isNotNull(), F.struct("entity", "qi"))
    made = estimates.filter(F.col("entity").isNotNull() & F.col("qi").isNotNull()).select(key.alias("_key"), "asof", *[F.col(c).alias(f"_{c}") for c in ("avg", "low", "high", "n")])
    x = asof_join(targets.withColumn("_key", key), made, "_key", "origin", "asof", ["_avg", "_low", "_high", "_n"], strict=True)
    new = {f"est_{c}": F.col(f"_{c}") for c in ("avg", "high", "low", "n")} | {"est_age": F.datediff("origin", F.col("asof_date"))}
    new |= {"est_dispersion": F.try_divide(F.col("_high") - F.col("_low"), F.col("_avg")), "est_to_revenue": F.try_divide(F.col("_avg"), F.col("revenue")), "est_to_ttm": F.try_divide(F.col("_avg"), F.col("ttm"))}
    return x.select(*targets.columns, *[c.alias(n) for n, c in new.items()])


def expectation_features(targets: DataFrame, events: DataFrame, estimates: DataFrame, windows: tuple[int, ...] = (90, 180, 365)) -> DataFrame:
    """Guidance and estimates known at the origin of each distinct target (entity, qi, origin, target_quarter, revenue, ttm), side by side."""
    distinct = targets.dropDuplicates(["entity", "qi", "origin"])
    said = guidance_window_features(distinct, events, windows)
    expected = estimate_features(distinct, estimates).select("entity", "qi", "origin", *[f"est_{c}" for c in ("avg", "high", "low", "n", "age", "dispersion", "to_revenue", "to_ttm")])
    return said.join(expected, ["entity", "qi", "origin"], "left")
