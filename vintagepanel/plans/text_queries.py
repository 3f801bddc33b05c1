"""Queries of the ingest, fundamentals, text and universe operators, each with the same in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.operators import fundamentals, text, universe
from vintagepanel.plans import views as v
from vintagepanel.plans.panel_queries import sql_round
from vintagepanel.plans.views import DAILY, DOCS, FACTS, GUIDED, SERIES_WIDE, rounded
from vintagepanel.sources import feeds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_TIES = ("tag", "l_orderkey", "l_linenumber")
_ONE = f"""{FACTS}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, concept, "end" ORDER BY prio, filed DESC, tag, l_orderkey, l_linenumber) AS n FROM facts) WHERE n = 1)"""


@query(f'WITH {_ONE} SELECT entity, concept, "end", tag, filed, val, l_orderkey, l_linenumber FROM one')
def restatements_latest(spark: SparkSession, d: str) -> DataFrame:
    return fundamentals.one_per_period(v.facts(spark, d), ties=_TIES).select("entity", "concept", "end", "tag", "filed", "val", "l_orderkey", "l_linenumber")


@query(f"""WITH {FACTS}, one AS (SELECT *, row_number() OVER (PARTITION BY entity, concept, "end" ORDER BY prio, filed, tag, l_orderkey, l_linenumber) AS n FROM facts)
SELECT entity, concept, "end", tag, filed, val, l_orderkey, l_linenumber FROM one WHERE n = 1""")
def restatements_first(spark: SparkSession, d: str) -> DataFrame:
    return fundamentals.one_per_period(v.facts(spark, d), first_reported=True, ties=_TIES).select("entity", "concept", "end", "tag", "filed", "val", "l_orderkey", "l_linenumber")


_CONCEPTS = ["quantity", "extendedprice", "discount", "tax"]


@query(f"""WITH {_ONE}, w AS (SELECT entity, "end", {', '.join(f"arg_max(val, (filed, tag)) FILTER (WHERE concept = '{c}') AS {c}" for c in _CONCEPTS)}, max(filed) AS filed, arg_max(tag, (filed, tag)) FILTER (WHERE concept = 'quantity') AS quantity_tag
FROM one WHERE NOT (concept = 'quantity' AND val < 10) GROUP BY 1, 2)
SELECT entity, "end", coalesce(quantity, discount + tax) AS quantity, extendedprice, discount, tax, filed,
       CASE WHEN quantity IS NULL AND discount + tax IS NOT NULL THEN 'proxy:discount+tax' WHEN quantity IS NULL THEN 'missing' ELSE 'direct:' || quantity_tag END AS quantity_source FROM w""")
def wide_facts(spark: SparkSession, d: str) -> DataFrame:
    one = fundamentals.one_per_period(v.facts(spark, d), ties=_TIES).filter("NOT (concept = 'quantity' AND val < 10)")
    wide = fundamentals.with_source(fundamentals.pivot_wide(one, _CONCEPTS), "quantity", ("discount", "tax"))
    return wide.drop("quantity_tag")


_QTRS = """qt AS (
  SELECT c_custkey AS entity, 'revenue' AS concept, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS "end", round(sum(o_totalprice), 2) AS val
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
yr AS (SELECT entity, concept, make_date(year("end"), 1, 1) AS start, make_date(year("end"), 12, 31) AS "end", sum(val) AS val FROM qt GROUP BY entity, concept, year("end")),
q3 AS (SELECT * FROM qt WHERE quarter("end") < 4 OR entity % 7 = 0)"""


@query(f"""WITH {_QTRS}, f AS (SELECT yr.entity, yr.concept, yr."end", yr.val AS whole, count(DISTINCT q3."end") AS n, count(*) AS m, sum(q3.val) AS three, max(q3."end") AS last
  FROM yr JOIN q3 ON yr.entity = q3.entity AND yr.concept = q3.concept AND q3.start >= yr.start - 8 AND q3."end" <= yr."end" + 8 AND q3."end" < yr."end" - 20 GROUP BY ALL)
SELECT f.entity, f.concept, CAST(last + 1 AS DATE) AS start, f."end", round(whole - three, 2) + 0.0e0 AS val FROM f LEFT JOIN q3 k ON f.entity = k.entity AND f."end" = k."end" WHERE n = 3 AND m = 3 AND k.entity IS NULL""")
def residual_quarter(spark: SparkSession, d: str) -> DataFrame:
    o, c = v.table(spark, d, "orders"), v.table(spark, d, "customer")
    start = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    q = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("entity"), start.alias("start")).agg(v.cents(F.col("o_totalprice")).alias("val"))
    q = q.select("entity", F.lit("revenue").alias("concept"), "start", F.last_day(F.add_months("start", 2)).alias("end"), "val")
    year = F.year("end")
    years = q.groupBy("entity", "concept", F.make_date(year, F.lit(1), F.lit(1)).alias("start"), F.make_date(year, F.lit(12), F.lit(31)).alias("end")).agg(F.sum("val").alias("val"))
    reported = q.filter((F.quarter("end") < 4) | (F.col("entity") % 7 == 0))
    return rounded(fundamentals.derive_last_quarter(reported, years), ["val"], 2)


@query(f"""WITH {FACTS}, k AS (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber % 2 = 0 THEN "end" - 91 ELSE "end" - 365 END AS start, CASE tag WHEN 'A' THEN '10-Q' WHEN 'N' THEN '10-K' ELSE '8-K' END AS form FROM facts)
SELECT CASE WHEN start IS NULL THEN 'instant' WHEN "end" - CAST(start AS DATE) BETWEEN 60 AND 100 THEN 'quarterly' ELSE 'annual' END AS kind, form, count(*) AS n FROM k WHERE form IN ('10-Q', '10-K') GROUP BY ALL""")
def classify_facts(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    start = F.when(line == 1, F.lit(None).cast("date")).when(line % 2 == 0, F.date_sub("end", 91)).otherwise(F.date_sub("end", 365))
    form = F.when(F.col("tag") == "A", "10-Q").when(F.col("tag") == "N", "10-K").otherwise("8-K")
    x = fundamentals.classify(v.facts(spark, d).withColumns({"start": start, "form": form}))
    return x.groupBy("kind", "form").agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS}, l AS (SELECT entity, "end", year("end") AS fy, CASE WHEN l_linenumber = 5 THEN 'FY' WHEN l_linenumber > 5 THEN 'H1' ELSE 'Q' || CAST(l_linenumber AS VARCHAR) END AS fp, CASE WHEN l_linenumber = 5 THEN 5 WHEN l_linenumber > 5 THEN 6 ELSE l_linenumber END AS o FROM facts)
SELECT entity, "end", CAST(arg_min(fy, (o, fy, fp)) AS INTEGER) AS fy, arg_min(fp, (o, fy, fp)) AS fp FROM l GROUP BY 1, 2""")
def fiscal_labels(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    fp = F.when(line == 5, "FY").when(line > 5, "H1").otherwise(F.concat(F.lit("Q"), line.cast("string")))
    return fundamentals.fiscal_label(v.facts(spark, d).withColumns({"fy": F.year("end"), "fp": fp}))


@query(f"WITH {SERIES_WIDE} SELECT * FROM wide")
def align_series(spark: SparkSession, d: str) -> DataFrame:
    return feeds.align_series(v.series_long(spark, d), v.SERIES)


@query(f"WITH {DAILY} SELECT n_name AS entity, count(px) AS n_rows, count(px) > 0 AS ok, min(date) AS first, max(date) AS last, max(CASE WHEN px IS NOT NULL THEN 'orders' END) AS source FROM nation LEFT JOIN daily ON n_name = entity GROUP BY 1")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    raw = v.daily(spark, d).withColumnRenamed("date", "ts")
    return feeds.coverage_report(v.table(spark, d, "nation").select(F.col("n_name").alias("entity")), feeds.normalize_prices(raw, "px", "volume", "orders"))


@query("""SELECT user_id AS entity, CAST(ts - INTERVAL 330 MINUTE AS DATE) AS date, value AS px, CAST(event_id % 100 AS DOUBLE) AS volume, 'events' AS source FROM events WHERE event_id % 9 > 0""")
def normalize_prices(spark: SparkSession, d: str) -> DataFrame:
    """Events as quotes stamped in the local time of a zone, dated in UTC; every ninth lacks a close and goes."""
    k = F.col("event_id")
    raw = v.table(spark, d, "events").select(F.col("user_id").alias("entity"), "ts", F.when(k % 9 > 0, F.col("value")).alias("close"), (k % 100).alias("shares"))
    return feeds.normalize_prices(raw, "close", "shares", "events", "Asia/Kolkata")


@query(f"WITH {DOCS} SELECT doc_id, entity, date FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC, doc_id DESC) AS n FROM docs) WHERE n <= 5")
def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    return feeds.latest_documents(v.doc_rows(spark, d).select("doc_id", "entity", "date"), 5)


@query(f"""WITH {DOCS}, p AS (SELECT doc_id, entity, row_number() OVER (PARTITION BY entity ORDER BY date, doc_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS c FROM docs),
k AS (SELECT DISTINCT entity, CAST(round_even(j * (c - 1) / 6e0, 0) AS BIGINT) AS i FROM p, (SELECT unnest(generate_series(0, 6)) AS j))
SELECT doc_id, p.entity FROM p LEFT JOIN k ON p.entity = k.entity AND p.i = k.i WHERE c <= 7 OR k.i IS NOT NULL""")
def spaced_documents(spark: SparkSession, d: str) -> DataFrame:
    return feeds.spaced_documents(v.doc_rows(spark, d).select("doc_id", "entity", "date"), 7).select("doc_id", "entity")


@query("""WITH t AS (SELECT conv_id AS entity, 'all' AS quarter, turn, role AS speaker, text AS content FROM conversations)
SELECT entity, quarter, CAST(row_number() OVER (PARTITION BY entity ORDER BY turn, speaker, content) - 1 AS INTEGER) AS turn_index, speaker, content, CAST(turn AS DOUBLE) AS sentiment_score FROM t""")
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "conversations")
    entry = F.struct("turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    raw = c.groupBy(F.col("conv_id").alias("entity")).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    listed = F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), F.lit(None).cast("string").alias("title"), x["content"].alias("content"), x["turn"].cast("string").alias("sentiment"), F.lit("").alias("sentiment_score")))
    return feeds.transcript_turns(raw.select("entity", F.lit("all").alias("quarter"), listed.alias("transcript"))).drop("title")


@query("""WITH n AS (SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_id % 3 = 0)
SELECT event_id, user_id, value, CAST(NULL AS VARCHAR) AS event_type FROM n UNION ALL SELECT event_id, user_id, value, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM n)""")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    new = e.filter("event_id % 3 = 0").select("event_id", "user_id", (F.col("value") * 2).alias("value"))
    return feeds.incremental_merge(feeds.incremental_merge(e, new, ["event_id"]), new, ["event_id"])


@query("SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    return feeds.run_manifest({t: v.table(spark, d, t) for t in ("orders", "lineitem", "events")})


@query("SELECT DISTINCT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi FROM orders WHERE year(o_orderdate) * 4 + quarter(o_orderdate) - 1 BETWEEN 7988 AND 7999")
def quarters_between(spark: SparkSession, d: str) -> DataFrame:
    return feeds.quarters_between(feeds.with_quarter(v.table(spark, d, "orders").select("o_orderdate"), "o_orderdate"), 7988, 7999)


@query("""SELECT c_name AS ticker, c_custkey AS entity, CASE WHEN s_suppkey IS NOT NULL THEN s_suppkey END AS id, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS id_str
FROM customer LEFT JOIN (SELECT upper(trim(replace(s_name, '.', '-'))) AS s, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON upper(trim(replace(replace(c_name, 'Customer', 'Supplier'), '.', '-'))) = s""")
def resolve_keys(spark: SparkSession, d: str) -> DataFrame:
    c, s = v.table(spark, d, "customer"), v.table(spark, d, "supplier")
    u = c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("entity"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("ticker"))
    return feeds.resolve_keys(u, s.select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("id"))).select(F.col("name").alias("ticker"), "entity", "id", "id_str")


@query("""WITH o AS (SELECT o_orderpriority AS industry, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(quarter(o_orderdate) AS VARCHAR) AS q, CAST(sum(CAST(round(o_totalprice, 0) AS BIGINT)) AS BIGINT) AS s FROM orders GROUP BY 1, 2, 3)
SELECT industry, CAST(y AS BIGINT) * 4 + CAST(q AS BIGINT) - 1 AS qi, CAST(s AS DOUBLE) AS value FROM o""")
def industry_observations(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    roman = F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("III"), F.lit("IV")), F.quarter("o_orderdate"))
    total = F.format_number(F.sum(F.round("o_totalprice", 0).cast("long")), 0)
    raw = o.groupBy(F.col("o_orderpriority").alias("Industry"), F.year("o_orderdate").cast("string").alias("Year"), roman.alias("Quarter")).agg(total.alias("DataValue"))
    return feeds.industry_observations(raw)


# thirteen lexicons for the test texts, by rule: the words that stand in many places, dealt by length; lexicons of a trade come as a table of the caller's
_WORDS = r"""tk AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z][a-zA-Z\-'']+'), lambda x: lower(trim(x, '-''')))) AS w FROM documents)"""
_LEX = ["positive", "negative", "uncertain", "litigious", "modal", "guidance", "demand", "supply", "cost", "people", "risk", "cloud", "capital"]
_LEXICON_SQL = f"""{_WORDS}, lx AS (SELECT w AS word, unnest([length(w) % 13, length(w) * 7 % 13]) AS l FROM tk GROUP BY w HAVING count(*) >= 20)"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """lexicon, word: a word is in one lexicon or two."""
    words = v.table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").count().filter("count >= 20")
    n = F.length("word")
    return words.select("word", F.explode(F.array(n % 13, n * 7 % 13)).alias("l")).select(F.element_at(F.array(*[F.lit(x) for x in _LEX]), F.col("l") + 1).alias("lexicon"), "word")


_TONES = [f"share_{k}" for k in _LEX] + ["net_tone", "tone_ratio"]


@query(f"""WITH {_LEXICON_SQL}, t AS (SELECT d.doc_id, count(w) AS n_words FROM documents d LEFT JOIN tk ON d.doc_id = tk.doc_id GROUP BY 1),
k AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE l = {i}) AS n_{x}" for i, x in enumerate(_LEX))} FROM tk JOIN (SELECT DISTINCT word, l FROM lx) ON w = word GROUP BY 1),
a AS (SELECT t.doc_id, n_words, {', '.join(f"coalesce(n_{x}, 0) AS n_{x}" for x in _LEX)} FROM t LEFT JOIN k ON t.doc_id = k.doc_id),
s AS (SELECT *, {', '.join(f'n_{x} / greatest(n_words, 1) AS share_{x}' for x in _LEX)}, (n_positive - n_negative) / greatest(n_words, 1) AS net_tone, n_positive / greatest(n_negative, 1) AS tone_ratio FROM a)
SELECT doc_id, n_words, {', '.join(f'n_{x}' for x in _LEX)}, {sql_round(_TONES)} FROM s""")
def lexicon_counts(spark: SparkSession, d: str) -> DataFrame:
    x = text.tone(text.lexicon_counts(v.table(spark, d, "documents"), _lexicon(spark, d), _LEX, "doc_id"))
    return rounded(x, _TONES).select("doc_id", "n_words", *[f"n_{k}" for k in _LEX], *_TONES)


_METRICS_SQL = r"""m AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z][a-zA-Z\-'']+')) AS n_words,
  greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: trim(x) <> '')), 1) AS n_sentences,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[0-9]', '', 'g'))) / greatest(length(coalesce(text, '')), 1) AS digit_share FROM documents)"""


@query(f"WITH {_METRICS_SQL} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_sentences AS BIGINT) AS n_sentences, round(digit_share, 6) + 0.0e0 AS digit_share, round(n_words / n_sentences, 6) + 0.0e0 AS words_per_sentence FROM m")
def document_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = text.doc_metrics(v.table(spark, d, "documents"))
    return rounded(x, ["digit_share", "words_per_sentence"]).select("doc_id", "n_words", "n_sentences", "digit_share", "words_per_sentence")


_TEXT_SHARES = ["digit_share", "words_per_sentence", "tone"]
_TEXT_WINDOWS = (90, 180, 365)
_TEXT_ROUNDED = [f"{x}_{k}" for k in _TEXT_WINDOWS for x in _TEXT_SHARES] + ["latest_tone"]


def _weighted(x: str, k: int) -> str:
    return f"sum(greatest(n_words, 1) * coalesce({x}, 0)) FILTER (WHERE age <= {k}) / sum(greatest(n_words, 1)) FILTER (WHERE age <= {k}) AS {x}_{k}"


@query(f"""WITH {DOCS}, {_METRICS_SQL}, dm AS (SELECT docs.doc_id, entity, date, form, n_words, n_sentences, digit_share, n_words / n_sentences AS words_per_sentence, CASE WHEN n_words > 0 THEN (n_sentences % 5 - 2) / 10e0 END AS tone FROM docs JOIN m ON docs.doc_id = m.doc_id),
o AS (SELECT entity, CAST(t AS DATE) AS origin FROM (SELECT DISTINCT entity FROM docs), (SELECT unnest(generate_series(TIMESTAMP '2020-03-01', TIMESTAMP '2025-12-01', INTERVAL 3 MONTH)) AS t)),
j AS (SELECT o.*, dm.* EXCLUDE (entity), date_diff('day', dm.date, o.origin) AS age FROM o LEFT JOIN dm ON o.entity = dm.entity AND dm.date < o.origin),
a AS (SELECT entity, origin, {', '.join(f"count(doc_id) FILTER (WHERE age <= {k}) AS docs_{k}, count(*) FILTER (WHERE age <= {k} AND form = 'en') AS docs_en_{k}, count(*) FILTER (WHERE age <= {k} AND form IN ('de', 'fr')) AS docs_other_{k}, CAST(coalesce(sum(n_words) FILTER (WHERE age <= {k}), 0) AS BIGINT) AS words_{k}, CAST(sum(n_sentences) FILTER (WHERE age <= {k}) AS BIGINT) AS n_sentences_{k}, " + ', '.join(_weighted(x, k) for x in _TEXT_SHARES) for k in _TEXT_WINDOWS)},
       max(date) AS latest_date, arg_max(form, (date, doc_id)) FILTER (WHERE doc_id IS NOT NULL) AS latest_form, arg_max(coalesce(tone, -9), (date, doc_id)) FILTER (WHERE doc_id IS NOT NULL) AS latest_tone FROM j GROUP BY 1, 2)
SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0e0 AS {c}' for c in _TEXT_ROUNDED)}) FROM a""")
def trailing_text_features(spark: SparkSession, d: str) -> DataFrame:
    """Filings of each source; the last origins are years after the last document."""
    x = text.doc_metrics(v.doc_rows(spark, d)).withColumn("tone", F.when(F.col("n_words") > 0, (F.col("n_sentences") % 5 - 2) / 10)).drop("text")
    quarters = F.sequence(F.lit("2020-03-01").cast("date"), F.lit("2025-12-01").cast("date"), F.expr("interval 3 months"))
    origins = x.select("entity").distinct().select("entity", F.explode(quarters).alias("origin"))
    out = text.trailing_text_features(origins, x, _TEXT_WINDOWS, tuple(_TEXT_SHARES), ("n_sentences",), {"en": ["en"], "other": ["de", "fr"]}, ("form", "tone"))
    out = out.withColumn("latest_tone", F.when(F.col("latest_date").isNotNull(), F.coalesce("latest_tone", F.lit(-9.0))))
    return rounded(out, _TEXT_ROUNDED)


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


_GW = (7, 20, 365)
_GW_ROUNDED = ["latest_midpoint", "period_midpoint", "latest_width_pct", "period_width_pct", *(f"{x}_{k}" for k in _GW for x in ("midpoint", "width_pct"))] + [f"midpoint_{k}_to_{r}" for k in _GW for r in ("revenue", "ttm")] + [f"{p}_to_{r}" for p in ("latest", "period") for r in ("revenue", "ttm")]


def _last_of(x: str, where: str = "event_id IS NOT NULL") -> str:
    return f"arg_max({{'v': {x}}}, (date, event_id)) FILTER (WHERE {where})"


_ON = "event_id IS NOT NULL AND period = target_quarter"
_GUIDANCE_SQL = f"""{GUIDED},
gj AS (SELECT tg.*, date_diff('day', ge.date, tg.origin) AS age, ge.* EXCLUDE (entity) FROM tg LEFT JOIN ge ON tg.entity = ge.entity AND ge.date < tg.origin),
gw AS (SELECT entity, origin, qi, target_quarter, revenue, ttm,
  {', '.join(f"count(event_id) FILTER (WHERE age <= {k}) AS n_{k}, " + ', '.join(f"count(*) FILTER (WHERE age <= {k} AND action = '{a}') AS n_{a}_{k}" for a in text.COUNTED) + f", avg(midpoint) FILTER (WHERE age <= {k}) AS midpoint_{k}, avg(width_pct) FILTER (WHERE age <= {k}) AS width_pct_{k}" for k in _GW)},
  CAST(min(age) AS INTEGER) AS latest_age, ({_last_of('midpoint')}).v AS latest_midpoint, ({_last_of('width_pct')}).v AS latest_width_pct, ({_last_of('action')}).v AS la,
  count(*) FILTER (WHERE {_ON}) AS period_n, CAST(min(age) FILTER (WHERE {_ON}) AS INTEGER) AS period_age, ({_last_of('midpoint', _ON)}).v AS period_midpoint, ({_last_of('width_pct', _ON)}).v AS period_width_pct
  FROM gj GROUP BY entity, origin, qi, target_quarter, revenue, ttm),
gx AS (SELECT * EXCLUDE (la), {', '.join(f"midpoint_{k} / nullif({r}, 0) AS midpoint_{k}_to_{r}" for k in _GW for r in ('revenue', 'ttm'))}, {', '.join(f"{p}_midpoint / nullif({r}, 0) AS {p}_to_{r}" for p in ('latest', 'period') for r in ('revenue', 'ttm'))},
  {', '.join(f"CASE WHEN latest_age IS NOT NULL THEN CAST(la = '{a}' AS INTEGER) END AS latest_is_{a}" for a in text.FLAGGED)} FROM gw)"""
_GUIDANCE_OUT = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0e0 AS {c}' for c in _GW_ROUNDED)}) FROM gx"


@query(f"WITH {_GUIDANCE_SQL} {_GUIDANCE_OUT}")
def guidance_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every origin of January 2024, and two that lie long after the last statement."""
    return rounded(text.guidance_window_features(v.guided_targets(spark, d), v.guidance_events(spark, d), _GW), _GW_ROUNDED)


_EST_ROUNDED = ["est_dispersion", "est_to_revenue", "est_to_ttm"]


@query(f"""WITH {_GUIDANCE_SQL}, gf AS ({_GUIDANCE_OUT}),
ej AS (SELECT tg.entity, tg.origin, tg.revenue, tg.ttm, es.made, es.avg, es.low, es.high, es.n FROM tg JOIN es ON tg.entity = es.entity AND tg.qi = es.qi AND es.made < tg.origin),
eb AS (SELECT entity, origin, revenue, ttm, max(made) AS made, arg_max({{'a': avg, 'l': low, 'h': high, 'n': n}}, (made, avg, low, high, n)) AS x FROM ej GROUP BY entity, origin, revenue, ttm),
ex AS (SELECT entity, origin, x.a AS est_avg, x.h AS est_high, x.l AS est_low, x.n AS est_n, CAST(date_diff('day', made, origin) AS INTEGER) AS est_age, round((x.h - x.l) / nullif(x.a, 0), 6) + 0.0e0 AS est_dispersion,
  round(x.a / nullif(revenue, 0), 6) + 0.0e0 AS est_to_revenue, round(x.a / nullif(ttm, 0), 6) + 0.0e0 AS est_to_ttm FROM eb)
SELECT gf.*, ex.* EXCLUDE (entity, origin) FROM gf LEFT JOIN ex ON gf.entity = ex.entity AND gf.origin = ex.origin""")
def expectation_features(spark: SparkSession, d: str) -> DataFrame:
    """Guidance and estimates of each distinct target; targets are given twice."""
    t = v.guided_targets(spark, d)
    return rounded(text.expectation_features(t.unionByName(t), v.guidance_events(spark, d), v.estimates(spark, d), _GW), [*_GW_ROUNDED, *_EST_ROUNDED])


_STATEMENT = """st AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'We ' || CASE o_orderstatus WHEN 'F' THEN 'raised' WHEN 'O' THEN 'lowered' ELSE 'maintain' END || ' our outlook: revenue for Q' || CAST(1 + o_orderkey % 4 AS VARCHAR) || ' ' || CAST(year(o_orderdate) + 10 AS VARCHAR) || ' of $' || CAST(o_orderkey % 90 + 1 AS VARCHAR) || ' to $' || CAST(o_orderkey % 50 + 40 AS VARCHAR) || ' million.' WHEN o_orderkey % 3 = 1 THEN 'Net income and tax were flat; sales moved.' END AS text, o_orderstatus, o_orderdate FROM orders)"""


@query(f"""WITH {_STATEMENT} SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'raise' WHEN 'O' THEN 'lower' ELSE 'reaffirm' END AS action,
  CAST(year(o_orderdate) + 10 AS VARCHAR) || 'Q' || CAST(1 + o_orderkey % 4 AS VARCHAR) AS period, least(o_orderkey % 90 + 1, o_orderkey % 50 + 40) * 1e6 AS low, greatest(o_orderkey % 90 + 1, o_orderkey % 50 + 40) * 1e6 AS high,
  (o_orderkey % 90 + 1 + o_orderkey % 50 + 40) * 1e6 / 2 AS midpoint, abs(o_orderkey % 90 + 1 - (o_orderkey % 50 + 40)) * 1e6 AS width FROM st WHERE o_orderkey % 3 = 0""")
def guidance_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements written from the orders, read back as guidance."""
    o, k, s = v.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    verb = F.when(s == "F", "raised").when(s == "O", "lowered").otherwise("maintain")
    said = F.concat(F.lit("We "), verb, F.lit(" our outlook: revenue for Q"), (1 + k % 4).cast("string"), F.lit(" "), (F.year("o_orderdate") + 10).cast("string"), F.lit(" of $"), (k % 90 + 1).cast("string"), F.lit(" to $"), (k % 50 + 40).cast("string"), F.lit(" million."))
    docs = o.select("o_orderkey", F.when(k % 3 == 0, said).when(k % 3 == 1, "Net income and tax were flat; sales moved.").alias("text"))
    return text.guidance(docs, ["o_orderkey"])


@query("""WITH t AS (SELECT c_custkey AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi, CAST(date_trunc('quarter', min(o_orderdate)) AS DATE) AS origin, round(sum(o_totalprice), 2) AS revenue, 4e0 * count(*) AS ttm FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS qi, CAST(o_orderdate AS DATE) AS made, o_totalprice AS avg, o_totalprice * 0.75e0 AS low, o_totalprice * 1.5e0 AS high, CAST(o_orderkey % 9 AS BIGINT) AS n FROM orders),
j AS (SELECT t.*, e.made, e.avg, e.low, e.high, e.n FROM t LEFT JOIN e ON t.entity = e.entity AND t.qi = e.qi AND e.made < t.origin),
b AS (SELECT entity, qi, origin, revenue, ttm, arg_max(avg, (made, avg)) AS est_avg, arg_max(high, (made, avg)) AS est_high, arg_max(low, (made, avg)) AS est_low, arg_max(n, (made, avg)) AS est_n, CAST(date_diff('day', max(made), origin) AS INTEGER) AS est_age FROM j GROUP BY entity, qi, origin, revenue, ttm)
SELECT *, round((est_high - est_low) / nullif(est_avg, 0), 6) + 0.0e0 AS est_dispersion, round(est_avg / nullif(revenue, 0), 6) + 0.0e0 AS est_to_revenue, round(est_avg / nullif(ttm, 0), 6) + 0.0e0 AS est_to_ttm FROM b""")
def estimate_features(spark: SparkSession, d: str) -> DataFrame:
    o, c = v.table(spark, d, "orders"), v.table(spark, d, "customer")
    qi = v.quarter_index(F.col("o_orderdate"))
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("entity"), qi.alias("qi")).agg(F.to_date(F.date_trunc("quarter", F.min("o_orderdate"))).alias("origin"), v.cents(F.col("o_totalprice")).alias("revenue"), (F.count("*") * 4.0).alias("ttm"))
    p = F.col("o_totalprice")
    e = o.select(F.col("o_custkey").alias("entity"), (qi + 1).alias("qi"), F.to_date("o_orderdate").alias("asof"), p.alias("avg"), (p * 0.75).alias("low"), (p * 1.5).alias("high"), (F.col("o_orderkey") % 9).alias("n"))
    return rounded(text.estimate_features(t, e), _EST_ROUNDED)


_MAP = [("AUTOMOBILE", "Industry"), ("MACHINERY", "Industry"), ("BUILDING", "Property"), ("FURNITURE", "Home")]
_UNI = f"""cand AS (SELECT c_custkey AS entity, grp, md5(CAST(c_custkey AS VARCHAR) || '/7') AS h FROM customer JOIN (VALUES {', '.join(str(x) for x in _MAP)}) t(label, grp) ON c_mktsegment = label),
el AS (SELECT * FROM cand WHERE entity NOT IN (SELECT s_suppkey FROM supplier) AND entity IN (SELECT o_custkey FROM orders)),
rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h, entity) AS draw FROM el),
dr AS (SELECT *, CASE WHEN draw <= 20 THEN 'selected' ELSE 'backup' END AS role FROM rk WHERE draw <= 30)"""


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    x = universe.map_labels(c, spark.createDataFrame(_MAP, "label string, grp string"), "segment")
    x = universe.eligible(x, v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")), v.table(spark, d, "orders").select(F.col("o_custkey").alias("entity")))
    return universe.stratified(x.withColumn("h", F.md5(F.concat(F.col("entity").cast("string"), F.lit("/7")))), 20, 10, "h")


@query(f"WITH {_UNI} SELECT entity, grp, CAST(draw AS INTEGER) AS draw, role FROM dr")
def stratified_universe(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d).select("entity", "grp", "draw", "role")


@query(f"""WITH {_UNI}, lb AS (SELECT o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT dr.*, coalesce(n, 0) AS n, CASE WHEN role = 'selected' AND coalesce(n, 0) < 9 THEN 'weak' WHEN role = 'backup' AND coalesce(n, 0) >= 9 THEN 'spare' ELSE 'rest' END AS kind FROM dr LEFT JOIN lb ON dr.entity = lb.entity),
i AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY draw) AS i, least(count(*) FILTER (WHERE kind = 'weak') OVER (PARTITION BY grp), count(*) FILTER (WHERE kind = 'spare') OVER (PARTITION BY grp)) AS s FROM k)
SELECT entity, grp, n, CASE WHEN kind = 'weak' AND i <= s THEN 'dropped' WHEN kind = 'spare' AND i <= s THEN 'selected' ELSE role END AS role FROM i""")
def coverage_swap(spark: SparkSession, d: str) -> DataFrame:
    labelled = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"))
    return universe.coverage_swap(_drawn(spark, d), labelled, 9).select("entity", "grp", "n", "role")


@query("SELECT DISTINCT o_custkey AS entity, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def universe_members(spark: SparkSession, d: str) -> DataFrame:
    holdings = v.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity"))
    return universe.members(holdings, v.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")))
