"""Queries of constants, text, references, schedule selections and attribution, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.functions import text as TX
from tally.operators import footing, lineage

from .analytics import CENTS, EDGES, cents, t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


CONSTANTS = [("fee_rate", "0.1", "ratio", "The fee is 10% of sales."), ("floor", "1250000", "usd", "not below $1,250,000 in any year"), ("period_end", "2025-06-30", "date", "June 30, 2025"), ("rate", "0.075", "ratio", "seven per cent")]
_CONST = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in CONSTANTS)


def constants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSTANTS, "name string, value string, unit string, quote string")


@query("SELECT o_orderstatus, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2)) * 1) * 10 / 100) AS BIGINT) AS fee FROM orders WHERE o_orderdate <= DATE '2025-06-30' GROUP BY 1")
def const_lookup(spark, sf_dir):
    constants(spark).createOrReplaceTempView("tally_constants")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION const(n STRING) RETURNS DECIMAL(18,6) RETURN (SELECT max(try_cast(value AS DECIMAL(18,6))) FROM tally_constants WHERE name = n AND unit <> 'date')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION const_date(n STRING) RETURNS DATE RETURN (SELECT max(try_cast(value AS DATE)) FROM tally_constants WHERE name = n AND unit = 'date')")
    t(spark, sf_dir, "orders").createOrReplaceTempView("tally_orders")
    return spark.sql("SELECT o_orderstatus, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) * const('fee_rate') + 0.5) AS BIGINT) AS fee FROM tally_orders WHERE o_orderdate <= const_date('period_end') GROUP BY 1")


@query(f"SELECT name, name IN ('fee_rate', 'floor') AS shown FROM (VALUES {_CONST}) c(name, value, unit, quote) WHERE unit <> 'date'")
def quote_shows_value(spark, sf_dir):
    c = constants(spark).filter("unit <> 'date'")
    return c.select("name", TX.shows_value(F.col("quote"), F.expr("try_cast(value as decimal(28,10))")).alias("shown"))


@query("SELECT l_quantity * 1.0 AS q, count(*) AS n, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS text FROM lineitem GROUP BY 1, 3")
def plain_number(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.count("*").alias("n")).withColumn("text", TX.plain_number(F.col("q")))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%B %-d, %Y') AS long, strftime(o_orderdate, '%b %Y') AS span FROM orders")
def date_labels(spark, sf_dir):
    d = F.col("d")
    return t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", TX.long_date(d).alias("long"), TX.span_label(d, d).alias("span"))


_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in [*EDGES, ("F.net", "t.gone")])


@query(f"WITH e(reader, read) AS (VALUES {_EDGES}), k AS (SELECT reader AS id FROM e UNION VALUES ('room.orders'), ('room.rates')) SELECT reader, read FROM e WHERE read NOT IN (SELECT id FROM k)")
def dead_ends(spark, sf_dir):
    e = spark.createDataFrame([*EDGES, ("F.net", "t.gone")], "reader string, read string")
    known = e.select(F.col("reader").alias("read")).unionByName(spark.createDataFrame([("room.orders",), ("room.rates",)], "read string"))
    return e.join(known, "read", "left_anti").select("reader", "read")


@query(
    f"WITH RECURSIVE e(reader, read) AS (VALUES {', '.join(f'{x}' for x in EDGES)}), w(a, b) AS (SELECT reader, read FROM e UNION SELECT w.a, e.read FROM w JOIN e ON e.reader = w.b)"
    " SELECT a AS reader, string_agg(b, ';' ORDER BY b) AS roots FROM w WHERE b NOT IN (SELECT reader FROM e) GROUP BY 1"
)
def root_collapse(spark, sf_dir):
    e = spark.createDataFrame(EDGES, "reader string, read string")
    roots = lineage.closure(e).join(e.select(F.col("reader").alias("read")).distinct(), "read", "left_anti")
    return roots.groupBy("reader").agg(F.array_join(F.sort_array(F.collect_list("read")), ";").alias("roots"))


@query("SELECT c_custkey AS id, 'lost' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT s_suppkey, 'extra' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def lost_and_extra_ids(spark, sf_dir):
    c, o, s = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders"), t(spark, sf_dir, "supplier")
    lost = c.select(F.col("c_custkey").alias("id")).join(o.select(F.col("o_custkey").alias("id")), "id", "left_anti").withColumn("side", F.lit("lost"))
    extra = s.select(F.col("s_suppkey").alias("id")).distinct().join(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), "id", "left_anti").withColumn("side", F.lit("extra"))
    return lost.unionByName(extra)


ROOTS = ["http", "https://", "https://a", "http://www"]


@query("SELECT url, arg_max(root, length(root)) AS root FROM pages JOIN (VALUES " + ", ".join(f"('{r}')" for r in ROOTS) + ") r(root) ON starts_with(url, root) GROUP BY page_id, url")
def deepest_root(spark, sf_dir):
    """The longest registered prefix of each address; the roots are a short list of the program's."""
    roots = F.broadcast(spark.createDataFrame([(r,) for r in ROOTS], "root string"))
    return t(spark, sf_dir, "pages").join(roots, F.expr("startswith(url, root)")).groupBy("page_id", "url").agg(F.max_by("root", F.length("root")).alias("root")).select("url", "root")


# Schedule selections over a finished table: orders by month

_MONTHS = f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS c, count(*) AS n FROM orders GROUP BY 1"


def months(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.sum(cents("o_totalprice")).alias("c"), F.count("*").alias("n"))


@query(f"SELECT m, c, n FROM ({_MONTHS}) WHERE m <= DATE '1996-03-01'")
def schedule_through(spark, sf_dir):
    return footing.through(months(spark, sf_dir).withColumn("label", F.date_format("m", "yyyy-MM")), "m", "label", "1996-03").select("m", "c", "n")


@query(f"SELECT m, v FROM (SELECT m, CASE WHEN n % 3 = 0 THEN 0.001 ELSE c / 100.0 END AS v FROM ({_MONTHS})) WHERE round(v, 2) <> 0")
def schedule_nonzero(spark, sf_dir):
    x = months(spark, sf_dir).select("m", F.when(F.col("n") % 3 == 0, 0.001).otherwise(F.col("c") / 100).alias("v"))
    return footing.nonzero(x, ["v"])


@query(f"SELECT m, CAST(c AS DOUBLE) / 1000 AS c, n FROM ({_MONTHS})")
def schedule_scale(spark, sf_dir):
    return footing.scaled(months(spark, sf_dir), ["c"], 3)


@query(f"WITH x AS ({_MONTHS}), r AS (SELECT *, row_number() OVER (ORDER BY m) AS a, row_number() OVER (ORDER BY m DESC) AS b FROM x) SELECT m, c FROM r WHERE a <= 5 OR b <= 5")
def first_and_last_rows(spark, sf_dir):
    x = months(spark, sf_dir).select("m", "c")
    return x.orderBy("m").limit(5).unionByName(x.orderBy(F.desc("m")).limit(5)).distinct()


@query(f"SELECT CAST(sum(CASE WHEN m = DATE '1996-01-01' OR m = DATE '1996-02-01' THEN c WHEN m = DATE '1996-03-01' THEN -c END) AS BIGINT) AS value FROM ({_MONTHS})")
def cell_sum(spark, sf_dir):
    """{= [1996-01] + [1996-02] - [1996-03]} over a finished table."""
    sign = F.when(F.col("m").isin(date(1996, 1, 1), date(1996, 2, 1)), 1).when(F.col("m") == date(1996, 3, 1), -1)
    return months(spark, sf_dir).agg(F.sum(sign * F.col("c")).alias("value"))


# Recurring revenue choices


@query(
    f"WITH f(y, rate) AS (VALUES (1995, 110), (1996, 105), (1997, 98), (1998, 101)) SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')} * rate // 100) AS BIGINT) AS c FROM orders JOIN f ON y = year(o_orderdate) GROUP BY 1"
)
def fx_translation_year_start(spark, sf_dir):
    rates = F.broadcast(spark.createDataFrame([(1995, 110), (1996, 105), (1997, 98), (1998, 101)], "y int, rate int"))
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), cents("o_totalprice").alias("v")).join(rates, "y")
    return o.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.expr("v * rate div 100")).alias("c"))


@query(f"SELECT o_orderstatus, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS c FROM orders WHERE NOT (o_orderkey % 4 = 0 AND datediff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 90) GROUP BY 1")
def past_due_exclusion(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    late = (F.col("o_orderkey") % 4 == 0) & (F.date_diff(F.lit(date(1998, 1, 1)), F.to_date("o_orderdate")) > 90)
    return o.filter(~late).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("c"))


@query(
    f"WITH x AS (SELECT l_orderkey AS k, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS c FROM lineitem GROUP BY 1) SELECT o_orderkey, least({CENTS.format('o_totalprice')}, coalesce(c, 0), CAST(o_custkey * 100000 AS BIGINT)) AS agreed FROM orders LEFT JOIN x ON k = o_orderkey"
)
def all_agree(spark, sf_dir):
    """The lowest of what contract, invoice and cash say."""
    x = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("c"))
    both = t(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("a"), (F.col("o_custkey") * 100000).alias("b")).join(x, "o_orderkey", "left")
    return both.select("o_orderkey", F.least("a", F.coalesce("c", F.lit(0)), "b").alias("agreed"))


# Runs


@query("SELECT user_id, event_type, count(*) FILTER (r = 1) AS firsts, count(*) FILTER (r > 1) AS reruns FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, event_id % 5 ORDER BY ts) AS r FROM events) GROUP BY 1, 2")
def first_run_or_rerun(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type", F.col("event_id") % 5).orderBy("ts")
    e = t(spark, sf_dir, "events").withColumn("r", F.row_number().over(w))
    return e.groupBy("user_id", "event_type").agg(F.count_if(F.col("r") == 1).alias("firsts"), F.count_if(F.col("r") > 1).alias("reruns"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS malformed FROM events GROUP BY 1")
def json_records(spark, sf_dir):
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(k.isNull()).alias("malformed"))
