"""Queries of control totals, periods, figures, usage, recurring revenue and schedules, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.functions import money as MF
from tally.functions import periods as P
from tally.operators import arr, control, footing, intervals, lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dbl(c: str, places: int = 2):
    return F.round(F.col(c).cast("decimal(38,6)"), places).cast("double").alias(c)


CENTS = "CAST(round(CAST({0} AS DECIMAL(18,2)) * 100) AS BIGINT)"


def cents(c: str):
    return F.round(F.col(c).cast("decimal(18,2)") * 100).cast("bigint")


# Control totals, ties, populations


@query(
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2"
)
def control_totals_by_side_unit(spark, sf_dir):
    out = control.totals_by(t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.withColumn("total", F.col("total").cast("double"))


@query(
    "SELECT 'lineitem' AS tbl, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS total, count(*) FILTER (l_extendedprice IS NULL OR NOT isfinite(l_extendedprice)) AS refused FROM lineitem"
    " UNION ALL SELECT 'orders', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE), count(*) FILTER (o_totalprice IS NULL OR NOT isfinite(o_totalprice)) FROM orders"
)
def control_total_exact(spark, sf_dir):
    out = None
    for name, c in (("lineitem", "l_extendedprice"), ("orders", "o_totalprice")):
        x = control.control_total(t(spark, sf_dir, name), c).select(F.lit(name).alias("tbl"), F.col("rows").alias("n"), F.col("total").cast("double").alias("total"), "refused")
        out = x if out is None else out.unionByName(x)
    return out


@query(
    "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS total, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) END AS stated, o_orderstatus <> 'F' AS agrees FROM orders GROUP BY 1"
)
def stated_total_agreement(spark, sf_dir):
    g = control.totals_by(t(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice").withColumn("total", F.col("total").cast("double"))
    g = g.withColumn("stated", F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("total")))
    return g.select("o_orderstatus", "total", "stated", (F.abs(F.round(F.col("total") - F.col("stated"), 4)) <= 0.005).alias("agrees"))


@query(
    "SELECT 'o_totalprice' AS col, 2 AS scale UNION ALL SELECT 'l_quantity', CASE WHEN max(abs(l_quantity - round(l_quantity))) < 1e-9 THEN 0 ELSE 2 END FROM lineitem"
)
def money_scale_inference(spark, sf_dir):
    a = control.money_scale(t(spark, sf_dir, "orders"), "o_totalprice").select(F.lit("o_totalprice").alias("col"), "scale")
    return a.unionByName(control.money_scale(t(spark, sf_dir, "lineitem"), "l_quantity").select(F.lit("l_quantity").alias("col"), "scale"))


_TIE = f"WITH x AS (SELECT l_orderkey, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS lines FROM lineitem GROUP BY 1)"


@query(
    f"{_TIE} SELECT o_orderkey, {CENTS.format('o_totalprice')} AS a, lines AS b, coalesce(abs({CENTS.format('o_totalprice')} - lines) <= 5000000, false) AS within_abs,"
    f" coalesce(abs({CENTS.format('o_totalprice')} - lines) <= lines * 0.5, false) AS within_pct FROM orders LEFT JOIN x ON l_orderkey = o_orderkey"
)
def tie_orders_lineitem(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("b"))
    both = t(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("a")).join(x, "o_orderkey", "left")
    a, b = F.col("a"), F.col("b")
    return both.select("o_orderkey", "a", "b", control.tie(a, b, tolerance=5_000_000).alias("within_abs"), control.tie(a, b, percent=0.5).alias("within_pct"))


@query(
    "SELECT count(*) OVER () AS total_n, 0 AS included_n, '' AS what, 0 AS n FROM region WHERE false UNION ALL SELECT CAST(sum(n) OVER () AS BIGINT), CAST(sum(CASE WHEN what = 'included' THEN n ELSE 0 END) OVER () AS BIGINT), what, n FROM"
    " (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity < 5 THEN 'small' ELSE 'included' END AS what, count(*) AS n FROM lineitem GROUP BY 1)"
)
def population_exclusions(spark, sf_dir):
    return control.population(t(spark, sf_dir, "lineitem"), {"returned": F.col("l_returnflag") == "R", "small": F.col("l_quantity") < 5})


@query(
    "SELECT count(*) FILTER (o_orderkey % 101 = 0) AS only_a, 0::BIGINT AS only_b, count(*) FILTER (o_orderkey % 101 <> 0 AND o_orderkey % 37 = 0) AS differ, count(*) FILTER (o_orderkey % 101 <> 0 AND o_orderkey % 37 <> 0) AS same FROM orders"
)
def relation_equality(spark, sf_dir):
    a = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    b = a.filter("o_orderkey % 101 <> 0").withColumn("o_totalprice", F.col("o_totalprice") * F.when(F.col("o_orderkey") % 37 == 0, 1.001).otherwise(1 + 1e-13))
    return control.equal_relations(a, b, ["o_orderkey"])


_B = "(SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN {c} + 100 ELSE {c} END AS after FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT -o_orderkey, {c} FROM orders WHERE o_orderkey % 19 = 0)".format(c=CENTS.format("o_totalprice"))


@query(
    f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, before, after, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN before = after THEN 'unchanged' ELSE 'moved' END AS change"
    f" FROM (SELECT o_orderkey, {CENTS.format('o_totalprice')} AS before FROM orders) a FULL JOIN {_B} b ON a.o_orderkey = b.o_orderkey"
)
def ledger_diff(spark, sf_dir):
    a = t(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("v"))
    moved = a.filter("o_orderkey % 17 <> 0").withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 13 == 0, 100).otherwise(0))
    return control.ledger_diff(a, moved.unionByName(a.filter("o_orderkey % 19 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))), "o_orderkey", "v")


@query()
def result_hash_order_independent(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem")
    return control.result_hash(items)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def twin_rows(spark, sf_dir):
    return control.twin_rows(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS statements FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def conflicting_statements(spark, sf_dir):
    return control.conflicts(t(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


# Completeness, vouching, cutoff


@query(
    "SELECT c_custkey, c_name, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no activity' ELSE 'present' END AS finding FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def completeness_roster(spark, sf_dir):
    n = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    both = t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(n, "c_custkey", "left")
    return both.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.when(F.col("n").isNull(), "no activity").otherwise("present").alias("finding"))


@query(
    "SELECT p_partkey, CASE WHEN l.n IS NULL THEN 'no support' WHEN abs(l.price - p_retailprice) <= p_retailprice * 0.2 THEN 'supported' ELSE 'differs' END AS finding FROM part"
    " LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) / sum(CAST(l_quantity AS DECIMAL(18,2))) AS price FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey"
)
def vouch_items(spark, sf_dir):
    d = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    x = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((d("l_extendedprice") / d("l_quantity")).alias("price"))
    near = F.abs(F.col("price") - F.col("p_retailprice")) <= F.col("p_retailprice") * 0.2
    return t(spark, sf_dir, "part").join(x, "p_partkey", "left").select("p_partkey", F.when(F.col("price").isNull(), "no support").when(near, "supported").otherwise("differs").alias("finding"))


@query(
    "SELECT CASE WHEN o_orderdate <= DATE '1996-12-31' AND l_shipdate > DATE '1996-12-31' THEN 'shipped late' WHEN o_orderdate > DATE '1996-12-31' AND l_shipdate <= DATE '1996-12-31' THEN 'shipped early' ELSE 'same period' END AS finding,"
    f" count(*) AS n, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate BETWEEN DATE '1996-12-01' AND DATE '1997-01-31' GROUP BY 1"
)
def cutoff_window_trace(spark, sf_dir):
    end = F.lit(date(1996, 12, 31))
    o = t(spark, sf_dir, "orders").withColumn("od", F.to_date("o_orderdate")).filter(F.col("od").between(date(1996, 12, 1), date(1997, 1, 31)))
    both = t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("sd", F.to_date("l_shipdate"))
    finding = F.when((F.col("od") <= end) & (F.col("sd") > end), "shipped late").when((F.col("od") > end) & (F.col("sd") <= end), "shipped early").otherwise("same period")
    return both.groupBy(finding.alias("finding")).agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("c"))


# Periods


@query(f"SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 9 THEN 1 ELSE 0 END AS INTEGER) AS fy, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS c FROM orders GROUP BY 1")
def fiscal_year_rollup(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy(P.fiscal_year(F.col("o_orderdate"), 9).alias("fy")).agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("c"))


KEYS = ["fy1996", "1996q2", "fy1996h2", "fy1996p03", "1996-06", "ltm_1996-06", "ytd_1996-06", "w1996-06-10_1996-06-20"]
_VALUES = ", ".join(f"('{k}', '{P.parse(k)[0]}', DATE '{P.parse(k)[1]}', DATE '{P.parse(k)[2]}')" for k in KEYS)


@query(
    f"SELECT key, kind, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS c FROM orders JOIN (VALUES {_VALUES}) p(key, kind, s, e) ON CAST(o_orderdate AS DATE) BETWEEN s AND e GROUP BY 1, 2"
)
def ltm_ytd_columns(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return P.by_period(o, "day", P.dimension(spark, KEYS)).groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("c"))


@query(
    "SELECT year, count(*) AS n FROM orders JOIN (VALUES (1995, DATE '1995-01-02', DATE '1995-12-31'), (1996, DATE '1996-01-01', DATE '1996-12-29'), (1997, DATE '1996-12-30', DATE '1998-01-04')) y(year, s, e) ON CAST(o_orderdate AS DATE) BETWEEN s AND e GROUP BY 1"
)
def declared_calendar_52_53(spark, sf_dir):
    years = P.weeks_52_53(spark, date(1995, 1, 2), {1995: 52, 1996: 52, 1997: 53})
    o = t(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return P.by_period(o, "day", years).groupBy("year").agg(F.count("*").alias("n"))


@query(
    "WITH d AS (SELECT CAST(x AS DATE) AS date, dayofweek(x) NOT IN (0, 6) AND x NOT IN (DATE '1996-01-01', DATE '1996-12-25') AS ok FROM generate_series(DATE '1996-01-01', DATE '1997-01-31', INTERVAL 1 DAY) g(x)),"
    " n AS (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY date) AS INTEGER) AS n FROM d), s AS (SELECT a.date, b.date AS later FROM n a JOIN n b ON b.n = a.n + 5 AND b.ok)"
    " SELECT s.date, s.later, count(*) AS n FROM orders JOIN s ON CAST(o_orderdate AS DATE) = s.date WHERE s.date >= DATE '1996-12-01' AND s.date <= DATE '1996-12-31' GROUP BY 1, 2"
)
def business_day_cutoff(spark, sf_dir):
    cal = P.business_days(spark, date(1996, 1, 1), date(1997, 1, 31), holidays=(date(1996, 1, 1), date(1996, 12, 25)))
    later = cal.filter("is_business").select((F.col("n") - 5).alias("n"), F.col("date").alias("later"))
    shift = cal.join(later, "n").select("date", "later").filter(F.col("date").between(date(1996, 12, 1), date(1996, 12, 31)))
    o = t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return o.join(F.broadcast(shift), "date").groupBy("date", "later").agg(F.count("*").alias("n"))


@query(
    "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice FROM orders), s AS (SELECT CAST(x AS DATE) AS month FROM generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH) g(x))"
    f" SELECT s.month, CAST(coalesce(sum({CENTS.format('o_totalprice')}), 0) AS BIGINT) AS c FROM s LEFT JOIN m ON m.month = s.month AND {CENTS.format('o_totalprice')} % 3 = 0 GROUP BY 1"
)
def dense_months(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate")))
    spine = o.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    some = o.filter(cents("o_totalprice") % 3 == 0)
    return spine.join(some, "month", "left").groupBy("month").agg(F.coalesce(F.sum(cents("o_totalprice")), F.lit(0)).alias("c"))


@query("SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def local_date_posting(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(P.local_day(F.col("ts"), "America/New_York").alias("day")).agg(F.count("*").alias("n"))


# Figures and functions

_ME = "greatest(0, (1998 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) + 1)"


@query(f"SELECT o_orderkey, CAST({_ME} AS INTEGER) AS months FROM orders")
def months_elapsed_fn(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", MF.months_elapsed(F.col("o_orderdate"), F.lit(date(1998, 6, 30))).alias("months"))


@query(f"SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')} - (2 * {CENTS.format('o_totalprice')} * least(36, {_ME}) + 36) // 72) AS BIGINT) // 1000 AS c1000 FROM orders GROUP BY 1")
def carrying_amount_schedule(spark, sf_dir):
    left = MF.carrying_amount(F.col("o_totalprice"), F.col("o_orderdate"), 36, F.lit(date(1998, 6, 30)))
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), left.alias("v"))
    return o.groupBy("y").agg(F.count("*").alias("n"), F.floor(F.sum("v") / 10).cast("bigint").alias("c1000"))


@query(
    f"WITH f AS (SELECT concat('F.', o_orderstatus) AS id, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS value FROM orders GROUP BY 1) SELECT a.o_orderpriority, a.o_orderstatus, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS part, any_value(f.value) AS whole"
    " FROM orders a JOIN f ON f.id = concat('F.', a.o_orderstatus) GROUP BY 1, 2"
)
def statement_figures_fig_lookup(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    figures = o.groupBy(F.concat(F.lit("F."), "o_orderstatus").alias("id")).agg(F.sum(cents("o_totalprice")).alias("value"))
    figures.createOrReplaceTempView("tally_figures")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fig(i STRING) RETURNS BIGINT RETURN (SELECT max(value) FROM tally_figures WHERE id = i)")
    g = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum(cents("o_totalprice")).alias("part"))
    return g.withColumn("whole", F.expr("fig(concat('F.', o_orderstatus))"))


_F = "CASE WHEN {x} < 0 THEN concat('($', {b}, ')') ELSE concat('$', {b}) END"


@query(
    "SELECT c_custkey, " + _F.format(x="round(c_acctbal)", b="format('{:,}', abs(CAST(round(CAST(c_acctbal AS DECIMAL(18,2))) AS BIGINT)))") + " AS money,"
    " concat(format('{:,}', CAST(round(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS BIGINT)), ' days') AS days FROM customer WHERE abs(CAST(c_acctbal AS DECIMAL(18,2))) >= 1"
)
def money_format(spark, sf_dir):
    c = t(spark, sf_dir, "customer").filter(F.abs(F.col("c_acctbal").cast("decimal(18,2)")) >= 1)
    return c.select("c_custkey", MF.money(F.col("c_acctbal")).alias("money"), MF.figure(F.abs("c_acctbal"), F.lit("days")).alias("days"))


_TEXTS = ["$1,204.50", "(1,204)", "EUR 3.2m", "12 million", "1.5bn", "n/a", "-7", "$40k", "(€2.25 million)"]
_PARSED = [1204.5, -1204.0, 3200000.0, 12000000.0, 1500000000.0, None, -7.0, 40000.0, -2250000.0]


@query(" UNION ALL ".join(f"SELECT '{a}' AS text, CAST({'NULL' if b is None else b} AS DOUBLE) AS value" for a, b in zip(_TEXTS, _PARSED, strict=True)))
def money_parse(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _TEXTS], "text string").select("text", MF.parse_money(F.col("text")).alias("value"))


@query("SELECT doc_id, x AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS x FROM documents) GROUP BY 1, 2")
def money_tokens(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))
    return t(spark, sf_dir, "documents").select("doc_id", words.alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(
    "WITH k AS (SELECT DISTINCT CAST(x AS DOUBLE) AS v FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents) WHERE length(x) <= 3),"
    " p AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS pool FROM part)"
    " SELECT k.v, min(abs(pool - k.v)) AS gap, min(abs(pool - k.v)) <= 0.5 AS backed FROM k, p GROUP BY 1"
)
def prose_backing(spark, sf_dir):
    """Whole numbers of up to three digits in prose, as its SQL has them, against a pool of values. ``prose_backing_all`` takes every number."""
    x = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    k = t(spark, sf_dir, "documents").select(x.alias("x")).filter("length(x) <= 3").select(F.col("x").cast("double").alias("v")).distinct()
    pool = t(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("v"))
    return _backing(k, pool)


def _backing(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """``asked`` with the distance of v to the nearest pool value, and whether that is 0.5 at most."""
    gap = F.least(F.col("v") - F.col("low"), F.col("high") - F.col("v"))
    return intervals.nearest(asked, pool, "v").select(*asked.columns, gap.alias("gap"), (gap <= 0.5).alias("backed"))


_NUMBER = "^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$"


@query(
    "WITH k AS (SELECT DISTINCT x AS token, CASE WHEN regexp_matches(x, '" + _NUMBER + "') THEN CAST(replace(x, ',', '') AS DOUBLE) END AS v"
    " FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS x FROM documents)),"
    " p AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS pool FROM part),"
    " n AS (SELECT k.token, k.v, least(k.v - a.pool, b.pool - k.v) AS gap FROM k ASOF LEFT JOIN p a ON k.v >= a.pool ASOF LEFT JOIN p b ON k.v <= b.pool)"
    " SELECT token, v, gap, gap <= 0.5 AS backed FROM n"
)
def prose_backing_all(spark, sf_dir):
    """All numbers in prose, with groups and decimals, against a pool of values. Tokens that are not one number (dates, addresses) have a null v."""
    x = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))
    k = t(spark, sf_dir, "documents").select(x.alias("token")).distinct()
    k = k.withColumn("v", F.when(F.col("token").rlike(_NUMBER), F.regexp_replace("token", ",", "").cast("double")))
    return _backing(k, t(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("v")))


# Lineage

EDGES = [("F.rev", "t.billed"), ("F.rev", "t.fx"), ("t.billed", "room.orders"), ("t.fx", "room.rates"), ("F.net", "F.rev"), ("F.net", "t.fees"), ("t.fees", "room.orders"), ("t.fees", "t.fx")]
_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)


@query(
    f"WITH RECURSIVE e(reader, read) AS (VALUES {_EDGES}), w(node, depth) AS (SELECT 'F.net', 0 UNION SELECT e.read, w.depth + 1 FROM w JOIN e ON e.reader = w.node WHERE depth < 64) SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY node"
)
def lineage_order(spark, sf_dir):
    return lineage.lineage(spark.createDataFrame(EDGES, "reader string, read string"), "F.net")


@query(
    f"WITH RECURSIVE e(reader, read) AS (VALUES {_EDGES}), w(a, b) AS (SELECT reader, read FROM e UNION SELECT w.a, e.read FROM w JOIN e ON e.reader = w.b) SELECT a AS reader, b AS read FROM w"
)
def dependency_closure(spark, sf_dir):
    return lineage.closure(spark.createDataFrame(EDGES, "reader string, read string"))


@query()
def emptying_sensitivity(spark, sf_dir):
    """Which inputs move a figure when they are emptied."""
    tables = {n: t(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    steps = {
        "billed": "SELECT o_custkey, sum(cast(o_totalprice as decimal(18,2))) AS v FROM orders GROUP BY o_custkey",
        "named": "SELECT c.c_nationkey, sum(b.v) AS v FROM billed b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_nationkey",
    }
    return lineage.emptying(spark, tables, steps, "SELECT cast(sum(named.v) as double) AS value FROM named LEFT JOIN nation ON n_nationkey = c_nationkey")


# Usage

_EV = "CAST(epoch_us(ts) AS BIGINT)"


@query(f"SELECT user_id, arg_max(event_id, {_EV}) AS event_id, arg_max(event_type, {_EV}) AS event_type FROM events GROUP BY 1")
def last_wins_dedupe(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return intervals.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _spans(spark, sf_dir, length: int = 3600):
    e = t(spark, sf_dir, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")).cast("bigint")
    return e.select("user_id", F.col("event_id").alias("id"), F.expr(f"cast(unix_micros(cast(ts as timestamp)) div 1000000 as bigint)").alias("s"), (F.lit(length) + F.col("event_id") % 7 * 600).alias("d"), s.alias("us")).withColumn("e", F.col("s") + F.col("d"))  # noqa: F541


_S = "SELECT user_id, event_id AS id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST(epoch_us(ts) // 1000000 AS BIGINT) + 3600 + event_id % 7 * 600 AS e FROM events"


@query(
    f"WITH x AS ({_S}), o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS opens FROM x),"
    " i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o), g AS (SELECT user_id, island, max(e) - min(s) AS len FROM i GROUP BY 1, 2) SELECT user_id, count(*) AS islands, CAST(sum(len) AS BIGINT) AS covered FROM g GROUP BY 1"
)
def interval_union_active(spark, sf_dir):
    return intervals.interval_union(_spans(spark, sf_dir), "user_id", "s", "e")


@query(
    "SELECT e.event_id, coalesce(m.mark, f.mark) AS mark FROM (SELECT * FROM events WHERE event_id % 3 <> 0) e ASOF LEFT JOIN (SELECT user_id, ts, event_id AS mark FROM events WHERE event_id % 3 = 0) m ON e.user_id = m.user_id AND e.ts >= m.ts"
    " LEFT JOIN (SELECT user_id, arg_min(event_id, ts) AS mark FROM events WHERE event_id % 3 = 0 GROUP BY 1) f ON f.user_id = e.user_id"
)
def asof_attribution(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    marks = e.filter("event_id % 3 = 0").select("user_id", "ts", F.col("event_id").alias("mark"))
    return intervals.asof(e.filter("event_id % 3 <> 0"), marks, ["user_id"], "ts", "mark").select("event_id", "mark")


@query(
    f"WITH x AS ({_S}), p AS (SELECT b.user_id, b.id AS run, a.id AS step, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, abs(a.s - b.s) AS gap FROM x a JOIN x b ON a.user_id = b.user_id AND a.id % 2 = 0 AND b.id % 2 = 1 AND least(a.e, b.e) > greatest(a.s, b.s))"
    " SELECT user_id, run, step, overlap FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY overlap DESC, gap, step) AS r FROM p) WHERE r = 1"
)
def overlap_best_fit(spark, sf_dir):
    x = _spans(spark, sf_dir).select("user_id", "id", "s", "e")
    return intervals.best_overlap(x.filter("id % 2 = 0"), x.filter("id % 2 = 1"), "user_id", 7200)


RATES = [("click", 3, 15), ("view", 1, 5), ("purchase", 15, 75)]
_RATES = ", ".join(f"('{a}', {b}, {c})" for a, b, c in RATES)


@query(
    f"WITH r(tier, i, o) AS (VALUES {_RATES}), x AS (SELECT event_type, user_id % 2 AS half, count(*) AS n, CAST(sum(event_id % 1000 * i + event_id % 100 * o) AS BIGINT) AS cost, count(*) FILTER (tier IS NULL) AS unpriced FROM events LEFT JOIN r ON tier = event_type GROUP BY ROLLUP (event_type, user_id % 2))"
    " SELECT coalesce(event_type, 'all') AS event_type, CAST(coalesce(half, -1) AS BIGINT) AS half, n, cost, unpriced FROM x"
)
def cost_by_tier_rollup(spark, sf_dir):
    r = F.broadcast(spark.createDataFrame(RATES, "event_type string, i int, o int"))
    e = t(spark, sf_dir, "events").join(r, "event_type", "left").withColumn("half", F.col("user_id") % 2)
    cost = F.col("event_id") % 1000 * F.col("i") + F.col("event_id") % 100 * F.col("o")
    g = e.rollup("event_type", "half").agg(F.count("*").alias("n"), F.sum(cost).alias("cost"), F.count_if(F.col("i").isNull()).alias("unpriced"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("half", F.lit(-1)).cast("bigint").alias("half"), "n", "cost", "unpriced")


@query(
    "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.1), 2) AS p10, round(quantile_cont(o_totalprice, 0.9), 2) AS p90 FROM orders GROUP BY 1"
)
def quantile_history(spark, sf_dir):
    q = lambda x, n: F.round(intervals.quantile("o_totalprice", x), 2).alias(n)
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(q(0.5, "p50"), q(0.1, "p10"), q(0.9, "p90"))


_X = ["1", "CAST(l_quantity AS DECIMAL(18,2))", "CAST(l_discount AS DECIMAL(18,2))", "CAST(l_extendedprice AS DECIMAL(18,2))"]


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, CAST(sum(CAST({_X[i]} * {_X[j]} AS DECIMAL(28,4))) AS DOUBLE) AS s FROM lineitem" for i in range(3) for j in range(i, 4)))
def ridge_normal_equations(spark, sf_dir):
    d = lambda c: F.col(c).cast("decimal(10,2)")
    eq = intervals.normal_equations(t(spark, sf_dir, "lineitem"), [F.lit(1).cast("decimal(10,2)"), d("l_quantity"), d("l_discount")], d("l_extendedprice"))
    return eq.withColumn("s", F.col("s").cast("double"))


@query(
    " UNION ALL ".join(
        f"SELECT o_orderpriority, {i} AS i, {j} AS j, CAST(sum(sum({a} * {b})) OVER () - sum({a} * {b}) AS BIGINT) AS s FROM (SELECT o_orderpriority, 1 AS one, o_custkey % 10 AS x, CAST(o_totalprice AS DECIMAL(18,0))::BIGINT AS y FROM orders) GROUP BY 1"
        for i, a in enumerate(("one", "x")) for j, b in ((0, "one"), (1, "x"), (2, "y")) if j >= i
    )
)
def leave_one_group_out(spark, sf_dir):
    """Each group's fold: the sums of all rows less its own."""
    y = F.round(F.col("o_totalprice").cast("decimal(18,2)")).cast("bigint")
    eq = intervals.normal_equations(t(spark, sf_dir, "orders"), [F.lit(1).cast("bigint"), F.col("o_custkey") % 10], y, group="o_orderpriority")
    return eq.withColumn("s", F.expr("sum(s) over (partition by i, j) - s"))


# Footing and schedules


@query(
    f"SELECT coalesce(l_returnflag, '') AS f, coalesce(l_linestatus, '') AS s, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS c, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
)
def subtotal_rollup_footing(spark, sf_dir):
    g = control.subtotals(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return g.select(F.coalesce("l_returnflag", F.lit("")).alias("f"), F.coalesce("l_linestatus", F.lit("")).alias("s"), F.round(F.col("total") * 100).cast("bigint").alias("c"), "n", F.col("level").cast("bigint").alias("level"))


_M = f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS c FROM orders GROUP BY 1"


@query(
    f"WITH x AS ({_M}), y AS (SELECT *, CAST(sum(c) OVER (ORDER BY m) AS BIGINT) AS running FROM x) SELECT m, c, running, running + CASE WHEN month(m) = 6 THEN 1 ELSE 0 END AS stated, month(m) <> 6 AS foots FROM y"
)
def walk_waterfall(spark, sf_dir):
    g = t(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.sum(cents("o_totalprice")).alias("c"))
    w = F.expr("sum(c) over (order by m)")
    return control.walk(g.withColumn("stated", w + F.when(F.month("m") == 6, 1).otherwise(0)), "m", "c", "stated").select("m", "c", "running", "stated", "foots")


@query(
    "SELECT 'SUMIFS(l_quantity,l_returnflag,\"R\",l_discount,\">0.05\")' AS formula, CAST(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_discount > 0.05) AS DOUBLE) AS value FROM lineitem"
    " UNION ALL SELECT 'COUNTIFS(l_returnflag,\"A\")', CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) FROM lineitem UNION ALL SELECT 'SUM(l_quantity)-2*COUNTIFS(l_linestatus,\"O\")', CAST(sum(l_quantity) - 2 * count(*) FILTER (l_linestatus = 'O') AS DOUBLE) FROM lineitem"
)
def sumifs_countifs(spark, sf_dir):
    texts = ['SUMIFS(l_quantity,l_returnflag,"R",l_discount,">0.05")', 'COUNTIFS(l_returnflag,"A")', 'SUM(l_quantity)-2*COUNTIFS(l_linestatus,"O")']
    return footing.evaluate(t(spark, sf_dir, "lineitem"), texts)


@query(
    f"WITH x AS (SELECT o_orderkey, {CENTS.format('o_totalprice')} AS c FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY abs(c) DESC, o_orderkey) AS n FROM x)"
    " SELECT o_orderkey, c, 1::BIGINT AS rows FROM r WHERE n <= 25 UNION ALL SELECT NULL, CAST(sum(c) AS BIGINT), count(*) FROM r WHERE n > 25"
)
def schedule_topk_remainder(spark, sf_dir):
    return control.largest(t(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("c")), "c", "o_orderkey", 25)


@query("SELECT c_custkey, seg FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_mktsegment END AS seg FROM customer) WHERE trim(seg) = '' OR lower(seg) IN ('building', 'machinery')")
def schedule_where_keeps_blank(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_mktsegment")).alias("seg"))
    return footing.where(c, {"seg": ["BUILDING", "machinery"]})


@query(f"SELECT o_orderstatus, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS c, o_orderstatus <> 'P' AS agrees FROM orders GROUP BY 1")
def summary_equals_schedule(spark, sf_dir):
    s = t(spark, sf_dir, "orders").select("o_orderstatus", cents("o_totalprice").alias("c"))
    lines = s.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    stated = lines.select("o_orderstatus", F.col("n").alias("sn"), (F.col("c") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("sc"))
    return lines.join(stated, "o_orderstatus").select("o_orderstatus", "n", "c", ((F.col("n") == F.col("sn")) & (F.col("c") == F.col("sc"))).alias("agrees"))


# Recurring revenue

_C = f"SELECT o_orderkey AS k, o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS start, 12 * (1 + o_orderkey % 3) AS term, {CENTS.format('o_totalprice')} AS c FROM orders"
_SNAP = (
    f"c AS ({_C}), s AS (SELECT customer, CAST(x AS DATE) AS month, CAST(sum(c) AS BIGINT) AS arr FROM (SELECT customer, c, unnest(generate_series(start, CAST(start + (term - 1) * INTERVAL 1 MONTH AS DATE), INTERVAL 1 MONTH)) AS x FROM c) GROUP BY 1, 2)"
)


def contracts(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("start"), (12 * (1 + F.col("o_orderkey") % 3)).cast("int").alias("term"), cents("o_totalprice").alias("c"))


@query(f"WITH {_SNAP} SELECT month, count(*) AS customers, CAST(sum(arr) AS BIGINT) AS arr FROM s GROUP BY 1")
def arr_month_snapshot(spark, sf_dir):
    return arr.snapshot(contracts(spark, sf_dir)).groupBy("month").agg(F.count("*").alias("customers"), F.sum("arr").alias("arr"))


@query(
    f"WITH {_SNAP}, k AS (SELECT customer, month, arr AS now, 0 AS before FROM s UNION ALL SELECT customer, CAST(month + INTERVAL 1 MONTH AS DATE), 0, arr FROM s), m AS (SELECT customer, month, CAST(sum(now) AS BIGINT) AS now, CAST(sum(before) AS BIGINT) AS before FROM k GROUP BY 1, 2),"
    " o AS (SELECT min(month) AS month FROM s)"
    " SELECT m.month, CASE WHEN before = 0 AND m.month = o.month THEN 'opening' WHEN before = 0 AND EXISTS (SELECT 1 FROM s WHERE s.customer = m.customer AND s.month < m.month AND s.month >= m.month - INTERVAL 12 MONTH) THEN 'reinstated'"
    " WHEN before = 0 THEN 'new' WHEN now = 0 THEN 'churn' WHEN now > before THEN 'expansion' WHEN now < before THEN 'contraction' ELSE 'unchanged' END AS movement,"
    " count(*) AS customers, CAST(sum(now - before) AS BIGINT) AS change FROM m, o GROUP BY 1, 2"
)
def arr_bridge(spark, sf_dir):
    return arr.bridge(arr.snapshot(contracts(spark, sf_dir)))


@query(
    f"WITH {_SNAP} SELECT a.month AS cohort, CAST(sum(a.arr) AS BIGINT) AS opening, CAST(sum(coalesce(b.arr, 0)) AS BIGINT) AS closing, CAST(sum(least(a.arr, coalesce(b.arr, 0))) AS BIGINT) AS kept, count(*) AS customers, count(b.arr) AS retained"
    " FROM s a LEFT JOIN s b ON b.customer = a.customer AND b.month = a.month + INTERVAL 12 MONTH WHERE a.month + INTERVAL 12 MONTH <= (SELECT max(month) FROM s) GROUP BY 1"
)
def arr_retention(spark, sf_dir):
    return arr.retention(arr.snapshot(contracts(spark, sf_dir)))


@query(
    f"WITH {_SNAP}, m AS (SELECT month, CAST(sum(arr) AS BIGINT) AS arr FROM s GROUP BY 1) SELECT a.month, CAST(sum(b.arr) AS BIGINT) AS trailing3 FROM m a JOIN m b ON b.month BETWEEN CAST(a.month - INTERVAL 2 MONTH AS DATE) AND a.month GROUP BY 1"
)
def arr_trailing_windows(spark, sf_dir):
    m = arr.snapshot(contracts(spark, sf_dir)).groupBy("month").agg(F.sum("arr").alias("arr"))
    n = F.col("month_no")
    return m.withColumn("month_no", F.year("month") * 12 + F.month("month")).select("month", F.sum("arr").over(Window.orderBy(n).rangeBetween(-2, 0)).alias("trailing3"))


@query(
    "WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_custkey // 2 ELSE c_custkey - c_custkey % 10 END AS parent FROM customer), e AS (SELECT id, CASE WHEN parent IN (SELECT c_custkey FROM customer) THEN parent END AS parent FROM p),"
    " w(id, up) AS (SELECT id, id FROM e UNION SELECT w.id, e.parent FROM w JOIN e ON e.id = w.up WHERE e.parent IS NOT NULL) SELECT w.id, w.up AS root FROM w JOIN e ON e.id = w.up WHERE e.parent IS NULL"
)
def customer_root_parent(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id")
    parent = F.when(k % 10 == 0, None).when(k % 2 == 0, F.floor(k / 2)).otherwise(k - k % 10)
    edges = c.withColumn("parent", parent)
    known = c.select(F.col("id").alias("parent"), F.lit(True).alias("ok"))
    return arr.root_parent(edges.join(known, "parent", "left").select("id", F.when(F.col("ok"), F.col("parent")).alias("parent")))


@query(
    f"WITH c AS ({_C}), x AS (SELECT CAST(unnest(generate_series(start, CAST(start + (term - 1) * INTERVAL 1 MONTH AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month, k, c, term, c // term AS v FROM c), y AS (SELECT month, v + CASE WHEN month = max(month) OVER (PARTITION BY k) THEN c - v * term ELSE 0 END AS v FROM x) SELECT month, CAST(sum(v) AS BIGINT) AS recognised FROM y GROUP BY 1"
)
def billed_spread(spark, sf_dir):
    return arr.spread(contracts(spark, sf_dir))


# File profiles over documents' lines

_LINES = "SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"


@query(
    f"WITH x AS (SELECT doc_id, i, len(string_split(line, '|')) AS w FROM ({_LINES})), y AS (SELECT *, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, CAST(min(i) AS INTEGER) AS header, arg_min(w, i)::INTEGER AS width FROM y WHERE w >= 2 AND w = w1 AND w = w2 GROUP BY 1"
)
def header_detect(spark, sf_dir):
    from tally.sources import profile

    return profile.headers(t(spark, sf_dir, "documents"), "doc_id", "text", "|")


@query(
    f"SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '[ ]{{2,}}') AND NOT contains(line, ',')) * 2 > count(*) AS fixed_width FROM ({_LINES}) GROUP BY 1"
)
def fixed_width_detect(spark, sf_dir):
    from tally.sources import profile

    return profile.fixed_width(t(spark, sf_dir, "documents"), "doc_id", "text")
