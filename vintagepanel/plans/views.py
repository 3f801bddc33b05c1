"""Panels, series and events over the tables of a star schema, in Spark and in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.functions.quarters import quarter_index, quarter_label
from vintagepanel.functions.sizes import cut_lineage
from vintagepanel.operators import panel, series


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], n: int = 6) -> DataFrame:
    """Round for comparison; adding 0.0 takes the sign off zeros."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in columns})


def cents(x: Column, n: int = 2) -> Column:
    """A sum rounded to the decimals its terms have, so that the order of summing does not show."""
    return F.round(F.sum(x), n)


def dense(spark: SparkSession, d: str) -> DataFrame:
    """entity (nation), grp (region), qi, revenue, n_orders: every quarter of every entity."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", quarter_index(F.col("o_orderdate")).alias("qi")).agg(cents(F.col("o_totalprice")).alias("revenue"), F.count("*").alias("n_orders"))
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("grp"))
    return x.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select("entity", "grp", "qi", "revenue", "n_orders")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """entity (customer), grp (segment), qi, revenue: with gaps."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"), quarter_index(F.col("o_orderdate")).alias("qi")).agg(cents(F.col("o_totalprice")).alias("revenue"))


def ratios(spark: SparkSession, d: str) -> DataFrame:
    """entity (nation), grp, qi with revenue, cost, tax and qty of the lines."""
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("grp"))
    price = F.col("l_extendedprice")
    sold = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", quarter_index(F.col("o_orderdate")).alias("qi"))
    x = li.join(sold, F.col("l_orderkey") == F.col("o_orderkey"))  # lines are moved once, by order
    x = x.groupBy("c_nationkey", "qi").agg(cents(price).alias("revenue"), cents(price * F.col("l_discount"), 4).alias("cost"), cents(price * F.col("l_tax"), 4).alias("tax"), cents(F.col("l_quantity")).alias("qty"))
    return x.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select("entity", "grp", "qi", "revenue", "cost", "tax", "qty")


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """ratios with the lines of accounts made of them; gross profit and debt are missing in some quarters. The lines are read once, however often the accounts are used."""
    c = F.col
    new = {
        "gross_profit": F.when(c("qi") % 5 > 0, c("revenue") - c("cost")), "operating_income": c("revenue") - c("cost") - c("tax"), "depreciation": c("tax") * 0.5, "net_income": c("revenue") - c("cost") * 2.0,
        "research": c("tax") * 0.25, "overhead": c("cost") * 0.5, "capex": c("qty") * 10.0, "operating_cash": c("qty") * 20.0, "assets": c("revenue") * 3.0 + c("cost"), "deferred": c("cost") * 1.5,
        "receivables": c("tax") * 1.25, "goodwill": c("cost") * 2.0, "shares": c("qty"), "debt": F.when(c("qi") % 3 > 0, c("cost") * 3.0), "cash": c("tax") * 3.0,
    }
    return cut_lineage(ratios(spark, d)).withColumns(new)


def grown(spark: SparkSession, d: str) -> DataFrame:
    """The dense panel with yoy, qoq, ttm and naive forecasts."""
    return panel.baselines(series.clean_growth(dense(spark, d)))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """entity (nation), date, px, volume: days without orders are missing."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.to_date("o_orderdate").alias("date")).agg(cents(F.col("o_totalprice")).alias("px"), F.count("*").cast("double").alias("volume"))
    return x.join(F.broadcast(n.select("n_nationkey", F.col("n_name").alias("entity"))), F.col("c_nationkey") == F.col("n_nationkey")).select("entity", "date", "px", "volume")


def bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(cents(F.col("o_totalprice")).alias("px"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SERIES = ["p1", "p2", "p3", "p4", "p5"]


def series_long(spark: SparkSession, d: str) -> DataFrame:
    """series (order priority), date (first of a month), value as a string."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))
    x = o.groupBy(name.alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(cents(F.col("o_totalprice")).alias("v"))
    return x.select("series", "date", F.format_string("%.2f", "v").alias("value"))


def signed_events(spark: SparkSession, d: str) -> DataFrame:
    """entity (user), date, event_id, action, midpoint."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    act = F.when(F.col("event_id") % 7 == 3, "mention").when(kind == "purchase", "raise").when(kind == "error", "lower").when(kind == "view", "reaffirm").when(kind == "signup", "initiate").when(kind == "click", "withdraw").otherwise("mention")
    return e.select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "event_id", act.alias("action"), F.col("value").alias("midpoint"))


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Every entity of the events at each day of January 2024, and at two dates long after the last event."""
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    days = F.concat(days, F.array(F.lit("2024-10-15").cast("date"), F.lit("2025-06-01").cast("date")))
    return table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().select("entity", F.explode(days).alias("origin"))


def guided_targets(spark: SparkSession, d: str) -> DataFrame:
    """origins with qi and label of the origin's quarter, and stand-ins for known revenue (0 for some) and a year's revenue."""
    k = F.col("entity") % 7
    return origins(spark, d).select("entity", "origin", quarter_index(F.col("origin")).alias("qi"), quarter_label(quarter_index(F.col("origin"))).alias("target_quarter"), (k * 9.7).alias("revenue"), (k * 38 + 5.3).alias("ttm"))


def guidance_events(spark: SparkSession, d: str) -> DataFrame:
    """signed_events with the quarter they speak of and the width of their range; midpoints are scaled so that no mean of them ends in a rounding tie."""
    i = F.col("event_id")
    return signed_events(spark, d).withColumns({"period": F.concat(F.lit("202"), (4 + F.floor(i % 6 / 4)).cast("string"), F.lit("Q"), (1 + i % 4).cast("string")), "width_pct": F.when(i % 5 > 0, (i % 5) / 11), "midpoint": F.col("midpoint") / 7.3})


def estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimates for the quarter of the event and, for even events, the second quarter of 2025, made on the day of the event."""
    e = table(spark, d, "events")
    x, day = F.col("value"), F.to_date("ts")
    qi = F.when(F.col("event_id") % 2 == 0, F.lit(2025 * 4 + 1)).otherwise(quarter_index(day)).cast("long")
    return e.select(F.col("user_id").alias("entity"), qi.alias("qi"), day.alias("asof"), x.alias("avg"), (x * 0.75).alias("low"), (x * 1.5).alias("high"), (F.col("event_id") % 9).alias("n"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """entity (supplier), concept, tag, prio, end (quarter's end), filed, val and the line's key."""
    li = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    prio = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    cells = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"l_{c}").alias("val")) for c in ("quantity", "extendedprice", "discount", "tax")])
    rows = li.select(F.col("l_suppkey").alias("entity"), flag.alias("tag"), prio.alias("prio"), F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("end"), F.to_date("l_shipdate").alias("filed"), "l_orderkey", "l_linenumber", F.explode(cells).alias("c"))
    return rows.select("entity", "c.concept", "tag", "prio", "end", "filed", "c.val", "l_orderkey", "l_linenumber")


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, entity (source), date, form (language), text."""
    x = table(spark, d, "documents")
    return x.select("doc_id", F.col("source").alias("entity"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("date"), F.col("lang").alias("form"), "text")


DENSE = """dense AS (
  SELECT n_name AS entity, r_name AS grp, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi,
         round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)"""

SPARSE = """sparse AS (
  SELECT c_custkey AS entity, c_mktsegment AS grp, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi,
         round(sum(o_totalprice), 2) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""

RATIOS = """ratios AS (
  SELECT n_name AS entity, r_name AS grp, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi,
         round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * l_discount), 4) AS cost,
         round(sum(l_extendedprice * l_tax), 4) AS tax, round(sum(l_quantity), 2) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)"""


ACCOUNTS = f"""{RATIOS},
accounts AS (SELECT *, CASE WHEN qi % 5 > 0 THEN revenue - cost END AS gross_profit, revenue - cost - tax AS operating_income, tax * 0.5e0 AS depreciation, revenue - cost * 2e0 AS net_income, tax * 0.25e0 AS research,
  cost * 0.5e0 AS overhead, qty * 10e0 AS capex, qty * 20e0 AS operating_cash, revenue * 3e0 + cost AS assets, cost * 1.5e0 AS deferred, tax * 1.25e0 AS receivables, cost * 2e0 AS goodwill, qty AS shares,
  CASE WHEN qi % 3 > 0 THEN cost * 3e0 END AS debt, tax * 3e0 AS cash FROM ratios)"""


def growth_sql(source: str, name: str = "g") -> str:
    """yoy, qoq and ttm of a gap-free table in SQL."""
    return f"""{name}0 AS (
  SELECT * REPLACE (CASE WHEN revenue > 0 THEN revenue END AS revenue) FROM {source}),
{name}1 AS (
  SELECT *, revenue / nullif(lag(revenue, 4) OVER w, 0) - 1 AS y, revenue / nullif(lag(revenue, 1) OVER w, 0) - 1 AS q,
         CASE WHEN count(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4
              THEN sum(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS ttm
  FROM {name}0 WINDOW w AS (PARTITION BY entity ORDER BY qi)),
{name} AS (
  SELECT * EXCLUDE (y, q), CASE WHEN y > -0.95e0 AND y < 3e0 THEN y END AS yoy, CASE WHEN q > -0.95e0 AND q < 5e0 THEN q END AS qoq FROM {name}1)"""


def rolled(agg: str, x: str, low: str, high: str, least: int) -> str:
    frame = f"(PARTITION BY entity ORDER BY qi ROWS BETWEEN {low} AND {high})"
    return f"CASE WHEN count({x}) OVER {frame} >= {least} THEN {agg}({x}) OVER {frame} END"


GROWN = f"""{DENSE}, {growth_sql('dense')},
grown AS (
  SELECT *, lag(yoy, 1) OVER w AS b_persistence, lag(yoy, 4) OVER w AS b_seasonal,
         {rolled('avg', 'yoy', '4 PRECEDING', '1 PRECEDING', 2)} AS b_mean_4,
         {rolled('avg', 'yoy', '8 PRECEDING', '1 PRECEDING', 4)} AS b_mean_8,
         {rolled('avg', 'yoy', 'UNBOUNDED PRECEDING', '1 PRECEDING', 4)} AS b_history
  FROM g WINDOW w AS (PARTITION BY entity ORDER BY qi))"""

DAILY = """daily AS (
  SELECT n_name AS entity, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS px, CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""

BENCH = "bench AS (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS px FROM orders GROUP BY 1)"

SERIES_WIDE = """months AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, 'p' || substr(o_orderpriority, 1, 1) AS series, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1, 2),
wide AS (
  SELECT date, max(value) FILTER (WHERE series = 'p1') AS p1, max(value) FILTER (WHERE series = 'p2') AS p2, max(value) FILTER (WHERE series = 'p3') AS p3,
         max(value) FILTER (WHERE series = 'p4') AS p4, max(value) FILTER (WHERE series = 'p5') AS p5
  FROM months GROUP BY date)"""

EVENTS = """ev AS (
  SELECT user_id AS entity, CAST(ts AS DATE) AS date, event_id, value AS midpoint,
         CASE WHEN event_id % 7 = 3 THEN 'mention' ELSE CASE event_type WHEN 'purchase' THEN 'raise' WHEN 'error' THEN 'lower' WHEN 'view' THEN 'reaffirm' WHEN 'signup' THEN 'initiate' WHEN 'click' THEN 'withdraw' ELSE 'mention' END END AS action
  FROM events)"""


ORIGINS = """orig AS (
  SELECT entity, CAST(t AS DATE) AS origin FROM (SELECT DISTINCT user_id AS entity FROM events),
       (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS t UNION ALL SELECT TIMESTAMP '2024-10-15' UNION ALL SELECT TIMESTAMP '2025-06-01'))"""

GUIDED = f"""{EVENTS}, {ORIGINS},
tg AS (SELECT entity, origin, CAST(year(origin) * 4 + quarter(origin) - 1 AS BIGINT) AS qi, CAST(year(origin) AS VARCHAR) || 'Q' || CAST(quarter(origin) AS VARCHAR) AS target_quarter,
       entity % 7 * 9.7e0 AS revenue, entity % 7 * 38 + 5.3e0 AS ttm FROM orig),
ge AS (SELECT * REPLACE (midpoint / 7.3e0 AS midpoint), '202' || CAST(4 + event_id % 6 // 4 AS VARCHAR) || 'Q' || CAST(1 + event_id % 4 AS VARCHAR) AS period, CASE WHEN event_id % 5 > 0 THEN (event_id % 5) / 11e0 END AS width_pct FROM ev),
es AS (SELECT user_id AS entity, CASE WHEN event_id % 2 = 0 THEN 2025 * 4 + 1 ELSE year(ts) * 4 + quarter(ts) - 1 END AS qi, CAST(ts AS DATE) AS made, value AS avg, value * 0.75e0 AS low, value * 1.5e0 AS high, CAST(event_id % 9 AS BIGINT) AS n FROM events)"""


FACTS = """facts AS (
  SELECT l_suppkey AS entity, concept, l_returnflag AS tag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS prio,
         last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS "end", CAST(l_shipdate AS DATE) AS filed,
         CASE concept WHEN 'quantity' THEN l_quantity WHEN 'extendedprice' THEN l_extendedprice WHEN 'discount' THEN l_discount ELSE l_tax END AS val,
         l_orderkey, l_linenumber
  FROM lineitem, (SELECT unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS concept))"""

DOCS = "docs AS (SELECT doc_id, source AS entity, CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE) AS date, lang AS form, text FROM documents)"
