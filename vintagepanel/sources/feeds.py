"""Landed feeds to tidy tables, and incremental sinks."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagepanel.functions.quarters import quarter_index
from vintagepanel.functions.sizes import small

COMPANY_FACTS = "cik string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, fy: int, fp: string, form: string, filed: string, frame: string>>>>>>"
# fixed values: roman quarter numerals of the industry feed
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4"}


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none: blocks that depend on it are then left out."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ticker, sector and perhaps role: trimmed, with role selected or none; rows without a ticker go. A universe without members is an error."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(*[F.trim(F.col(c)).alias(c) for c in raw.columns]).filter("ticker <> ''")
    out = out.filter(F.coalesce("role", F.lit("")).isin("", "selected")) if "role" in raw.columns else out
    if out.limit(1).count() == 0:
        raise ValueError(f"the universe in {path} has no members")
    return out


def normal_symbol(c: Column) -> Column:
    return F.upper(F.trim(F.replace(c, F.lit("."), F.lit("-"))))


def resolve_keys(universe: DataFrame, keymap: DataFrame) -> DataFrame:
    """universe (ticker, ...) with id, id_str (ten digits) of keymap (ticker, id): the first id of a symbol; unresolved ones keep nulls."""
    w = Window.partitionBy("_s").orderBy("id")
    keys = keymap.select(normal_symbol(F.col("ticker")).alias("_s"), F.col("id").cast("long").alias("id")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    out = universe.withColumn("_s", normal_symbol(F.col("ticker"))).join(small(keys), "_s", "left").drop("_s")
    return out.withColumn("id_str", F.lpad(F.col("id").cast("string"), 10, "0"))


def unresolved(resolved: DataFrame) -> DataFrame:
    """The distinct symbols that resolve_keys found no id for."""
    return resolved.filter("id IS NULL").select("ticker").distinct()


#: What is wrong with a document of company facts.
NOT_JSON, NO_FACTS = "not JSON", "no facts"


def once(x: Column) -> Column:
    """x as a column of its own that filters further on refer to, instead of computing x again: for what is dear, such as parsing."""
    return F.explode(F.array(x))


def damaged_facts(raw: DataFrame) -> DataFrame:
    """entity, reason, json of the documents of company facts (entity, json) that give facts_to_long nothing: those that cannot be read as JSON of this shape, null ones among them, and those without a tag.

    A document loses itself alone; the table is to be kept beside what the others gave.
    """
    parsed = raw.select("entity", "json", once(F.from_json("json", f"{COMPANY_FACTS}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})).alias("f"))
    tags = F.map_keys(F.col("f.facts.us-gaap"))
    reason = F.when(F.col("json").isNull() | F.col("f").isNull() | F.col("f._corrupt_record").isNotNull(), NOT_JSON).when(F.coalesce(F.size(tags), F.lit(0)) <= 0, NO_FACTS)
    return parsed.select("entity", reason.alias("reason"), "json").filter("reason IS NOT NULL")


def facts_to_long(raw: DataFrame, concepts: DataFrame) -> DataFrame:
    """Nested company facts (entity, json) to rows. concepts: concept, tag, prio, unit (the preferred one); all tags of a concept are taken.

    A tag's values come from its preferred unit, or its first one if that is not there.
    Damaged documents have no rows; damaged_facts lists them.
    """
    parsed = raw.select("entity", once(F.from_json("json", COMPANY_FACTS)).alias("f")).select("entity", F.explode(F.col("f.facts.us-gaap")).alias("tag", "body"))
    matched = parsed.join(small(concepts), "tag")
    units = F.col("body.units")
    chosen = F.coalesce(F.try_element_at(units, F.col("unit")), F.get(F.map_values(units), F.lit(0)))
    used = F.when(F.map_contains_key(units, F.col("unit")), F.col("unit")).otherwise(F.get(F.map_keys(units), F.lit(0)))
    rows = matched.select("entity", "concept", "tag", "prio", used.alias("unit"), F.explode(chosen).alias("x"))
    date = lambda c: F.to_date(F.col(f"x.{c}"))
    return rows.select("entity", "concept", "tag", "prio", "unit", date("start").alias("start"), date("end").alias("end"), "x.val", "x.fy", "x.fp", "x.form", date("filed").alias("filed"), "x.frame")


def industry_observations(raw: DataFrame) -> DataFrame:
    """Industry rows (Industry, Year, Quarter, DataValue as strings) to industry, qi, value: separators stripped, roman or plain quarters; rows without a value are dropped."""
    quarter = F.upper(F.trim("Quarter"))
    for roman, digit in ROMAN.items():
        quarter = F.when(F.upper(F.trim("Quarter")) == roman, digit).otherwise(quarter)
    digit = F.regexp_extract(quarter, "([1-4])", 1).try_cast("long")
    value = F.replace("DataValue", F.lit(","), F.lit("")).try_cast("double")
    return raw.select(F.col("Industry").alias("industry"), (F.col("Year").try_cast("long") * 4 + digit - 1).alias("qi"), value.alias("value")).filter("value IS NOT NULL AND qi IS NOT NULL")


def align_series(long: DataFrame, names: list[str]) -> DataFrame:
    """(series, date, value string) to one row a date and a column a series; what is no number is null."""
    return long.withColumn("value", F.col("value").try_cast("double")).groupBy("date").pivot("series", names).agg(F.first("value", True))


def normalize_prices(raw: DataFrame, close: str, volume: str, source: str, zone: str | None = None) -> DataFrame:
    """entity, date (of ts in UTC, if ts is local time of a zone), px, volume, source; rows without a close are dropped."""
    return raw.filter(F.col(close).isNotNull()).select("entity", F.to_date(F.to_utc_timestamp("ts", zone) if zone else F.col("ts")).alias("date"), F.col(close).cast("double").alias("px"), F.col(volume).cast("double").alias("volume"), F.lit(source).alias("source"))


def coverage_report(universe: DataFrame, daily: DataFrame) -> DataFrame:
    """Rows, first and last date and source of every entity; zero rows where there are none."""
    found = daily.groupBy("entity").agg(F.count("*").alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.max("source").alias("source"))
    return universe.select("entity").distinct().join(found, "entity", "left").fillna(0, ["n_rows"]).withColumn("ok", F.col("n_rows") > 0)


def coverage_count(report: DataFrame) -> DataFrame:
    """n_entities and n_ok of a coverage report: one row."""
    return report.agg(F.count("*").alias("n_entities"), F.count_if("ok").alias("n_ok"))


def benchmarks_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """Index levels (index, date, level) aligned by date, one column an index; dates of any index are kept."""
    return long.groupBy("date").pivot("index", names).agg(F.first("level", True))


def filings_index(submissions: DataFrame, forms: list[str], since: str, base_url: str) -> DataFrame:
    """Parallel arrays (entity, id, accession, form, filed, document) to rows of the wanted forms, with the address of each document."""
    zipped = F.arrays_zip("accession", "form", "filed", "document")
    rows = submissions.select("entity", "id", F.inline(zipped)).withColumn("filed", F.to_date("filed"))
    kept = rows.filter(F.col("form").isin(forms) & (F.col("filed") >= F.lit(since).cast("date")))
    return kept.withColumn("url", F.format_string(f"{base_url}/%d/%s/%s", F.col("id"), F.replace("accession", F.lit("-"), F.lit("")), F.col("document")))


def latest_documents(docs: DataFrame, n: int, by: str = "entity", date: str = "date", ties: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(date), F.desc(ties))
    return docs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def spaced_documents(docs: DataFrame, n: int, by: str = "entity", date: str = "date", ties: str = "doc_id") -> DataFrame:
    """n documents spread evenly over each entity's: positions i*(count-1)/(n-1), halves to even; all where there are no more than n."""
    w = Window.partitionBy(by)
    x = docs.withColumns({"_i": F.row_number().over(w.orderBy(date, ties)) - 1, "_c": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_c") - 1) / max(1, n - 1), 0).cast("int"))
    return x.filter((F.col("_c") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_c")


def transcript_turns(raw: DataFrame) -> DataFrame:
    """entity, quarter, transcript (array of speaker, title, content, sentiment, sentiment_score) to rows with turn_index and a numeric score."""
    rows = raw.select("entity", "quarter", F.posexplode("transcript").alias("turn_index", "t"))
    return rows.select("entity", "quarter", "turn_index", "t.speaker", "t.title", "t.content", F.coalesce(F.col("t.sentiment_score").try_cast("double"), F.col("t.sentiment").try_cast("double")).alias("sentiment_score"))


def first_present(*columns: str) -> Column:
    """The first of the string columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def flatten_estimates(raw: DataFrame, run_date: str) -> DataFrame:
    """entity with arrays quarterly and annual of maps to rows: alternative keys tried in turn, as-of date the run's where none is given, the raw entry kept as JSON."""
    def tagged_as(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(F.lit(kind).alias("period_type"), m.alias("m")))

    tagged = F.concat(tagged_as("quarterly"), tagged_as("annual"))
    rows = raw.select("entity", F.explode(tagged).alias("x"))
    pick = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(F.col("x.m"), F.lit(k)), F.lit("")) for k in keys])
    return rows.select("entity", "x.period_type", pick("date", "fiscalDateEnding").alias("fiscal_date"), F.coalesce(pick("asof", "updated"), F.lit(run_date)).alias("asof"), pick("revenueAvg", "estimatedRevenueAvg").try_cast("double").alias("avg"), pick("revenueHigh", "estimatedRevenueHigh").try_cast("double").alias("high"), pick("revenueLow", "estimatedRevenueLow").try_cast("double").alias("low"), F.to_json("x.m").alias("raw"))


def flatten_news(raw: DataFrame) -> DataFrame:
    """entity, feed (array of title, time, score, sentiments array of ticker, score) to rows with the entity's own entry."""
    rows = raw.select("entity", F.explode("feed").alias("x"))
    own = F.get(F.filter("x.sentiments", lambda s: s["ticker"] == F.col("entity")), F.lit(0))
    return rows.select("entity", "x.title", "x.time", "x.score", own["score"].try_cast("double").alias("own_score"))


def flatten_rows(raw: DataFrame, column: str) -> DataFrame:
    """entity and the fields of each struct of an array."""
    return raw.select("entity", F.inline(column))


def short_interest_rows(raw: DataFrame) -> DataFrame:
    """ticker (dots taken out as the provider's key), settlement date and positions as numbers."""
    return raw.select(F.replace("ticker", F.lit("."), F.lit("")).alias("entity"), F.to_date("settlementDate").alias("date"), F.col("currentShortPositionQuantity").try_cast("double").alias("short"), F.col("daysToCoverQuantity").try_cast("double").alias("days_to_cover"))


def incremental_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new does not have, and all of new; a column one side lacks is null there. Merging the same new rows again changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> bool:
    """Write unless df is empty; says whether it wrote."""
    if df.limit(1).count() == 0:
        return False
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    return True


def run_manifest(tables: dict[str, DataFrame], run_at: str | None = None) -> DataFrame:
    """name, rows of each table, and run_at (a time as text) where it is given."""
    when = [F.lit(run_at).alias("run_at")] if run_at else []
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", *when) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quarters_between(panel: DataFrame, first: int, last: int) -> DataFrame:
    return panel.select("qi").distinct().filter(F.col("qi").between(first, last))


def with_quarter(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("qi", quarter_index(F.col(date)))
