"""Queries of the cache, schedules, recorded statements and periods, and their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions import money as MF
from tally.functions import periods as P
from tally.functions import text as TX
from tally.operators import ledger, lineage, schedule
from tally.operators.cut import shared_dir
from tally.sources import cache as C
from tally.sources import profile

from .analytics import CENTS, ORACLES, QUERIES, cents, query, t


def _cache(spark) -> C.Cache:
    return C.Cache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}")


# Cache, items, citations


@query("SELECT 'orders' AS id, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,6)) AS total, 'o_orderkey' AS grain FROM orders")
def cache_write_coordinates(spark, sf_dir) -> DataFrame:
    c = _cache(spark)
    orders = t(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    c.write("orders", orders, "orders.parquet", "o_totalprice", "an order", ["o_orderkey"])
    return c.coordinates().select("id", "rows", "total", F.array_join("grain", ",").alias("grain"))


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders GROUP BY 1")
def cache_derived_table(spark, sf_dir) -> DataFrame:
    c = _cache(spark)
    c.write("orders", t(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), "orders.parquet", "o_totalprice", "an order", ["o_orderkey"])
    return c.derive("by_status", "SELECT o_orderstatus AS status, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", "total", "a status", ["status"])


@query("SELECT count(*) AS rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,6)) AS total FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10")
def cited_select(spark, sf_dir) -> DataFrame:
    c = _cache(spark)
    lines = t(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    c.write("lineitem", lines.withColumn("n", F.monotonically_increasing_id()), "lineitem.parquet", "l_extendedprice", "a line", ["n"])
    return c.select("lineitem", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10")[1]


@query("SELECT count(*) AS rows, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DECIMAL(38,6)) AS total, CAST(0 AS BIGINT) AS refused FROM lineitem WHERE l_returnflag = 'R'")
def span_over_frame(spark, sf_dir) -> DataFrame:
    return C.span(t(spark, sf_dir, "lineitem").withColumn("l_tax", F.col("l_tax").cast("decimal(18,2)")), F.col("l_returnflag") == "R", "l_tax")


_ITEMS = f"SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, concat('o', o_orderkey) AS id, {CENTS.format('o_totalprice')} AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'eur' ELSE 'usd' END AS unit FROM orders"


@query(f"SELECT side, unit, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,6)) AS total FROM ({_ITEMS}) GROUP BY 1, 2")
def item_tables(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    items = t(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "left").otherwise("right").alias("side"), F.concat(F.lit("o"), k).alias("id"), cents("o_totalprice").alias("amount"), F.when(k % 3 == 0, "eur").otherwise("usd").alias("unit"))
    return _cache(spark).write_items("orders", items)


@query(
    "WITH x AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('o', o_orderkey // 2) END AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'usd' END AS unit FROM orders)"
    " SELECT 'no id' AS fault, count(*) AS n FROM x WHERE id IS NULL UNION ALL SELECT 'no unit', count(*) FROM x WHERE unit IS NULL"
    " UNION ALL SELECT 'id repeated', count(*) FROM (SELECT side, id FROM x GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0"
)
def item_rule_faults(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    x = t(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, "left").otherwise("right").alias("side"), F.when(k % 11 != 0, F.concat(F.lit("o"), F.floor(k / 2))).alias("id"), F.lit(1).alias("amount"), F.when(k % 13 != 0, "usd").alias("unit")
    )
    return C.item_faults(x)


@query("SELECT source AS file, lang AS source, CAST(doc_id % 7 AS VARCHAR) AS \"where\", arg_max(CAST(n_chars AS VARCHAR), doc_id) AS text FROM documents GROUP BY 1, 2, 3")
def notes_last_wins(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("source").alias("file"), F.col("lang").alias("source"), (F.col("doc_id") % 7).cast("string").alias("where"), F.col("n_chars").cast("string").alias("text"))
    return C.last_notes(d)


@query("SELECT count(*) AS rows, true AS same, false AS other FROM orders")
def content_hash(spark, sf_dir) -> DataFrame:
    """Equal rows in another order hash alike; one changed value doesn't."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_clerk") if "o_clerk" in t(spark, sf_dir, "orders").columns else t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, "?").otherwise(F.col("o_orderstatus")))
    one, two, three = (C.content_hash(x, ["o_orderkey"]) for x in (o, o.repartition(5), changed))
    first = one.first()
    return two.select("rows", (F.col("sha256") == first.sha256).alias("same"), F.lit(three.first().sha256 == first.sha256).alias("other"))


# File profiles on texts that have what is looked for

_TABLES = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN concat('report', chr(10), 'by ', c_name, chr(10)) ELSE '' END || 'id|name|bal' || chr(10) || concat(c_custkey, '|', c_name, '|', c_nationkey) || chr(10) || '1|2|3' AS text FROM customer"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END AS header, 3 AS width FROM ({_TABLES})")
def header_found(spark, sf_dir) -> DataFrame:
    t(spark, sf_dir, "customer").createOrReplaceTempView("tally_customer")
    return profile.headers(spark.sql(_TABLES.replace("FROM customer", "FROM tally_customer")), "doc_id", "text", "|")


_WIDE = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN rpad(c_name, 30, ' ') || 'x' || chr(10) || rpad(c_mktsegment, 30, ' ') || 'y' ELSE c_name || ',' || c_mktsegment || chr(10) || 'a,b' END AS text FROM customer"


@query(f"SELECT doc_id, CAST(2 AS BIGINT) AS lines, doc_id % 2 = 0 AS fixed_width FROM ({_WIDE})")
def fixed_width_found(spark, sf_dir) -> DataFrame:
    t(spark, sf_dir, "customer").createOrReplaceTempView("tally_customer")
    return profile.fixed_width(spark.sql(_WIDE.replace("FROM customer", "FROM tally_customer")), "doc_id", "text")


# Money and quotes over all amounts


@query(f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * {CENTS.format('o_totalprice')} AS DOUBLE) / 100 AS value FROM orders")
def money_round_trip(spark, sf_dir) -> DataFrame:
    """Amounts written with symbol, commas and parentheses, and read again."""
    x = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return t(spark, sf_dir, "orders").select("o_orderkey", MF.parse_money(MF.money(x, "$", 2)).alias("value"))


@query("SELECT doc_id, try_cast(replace(replace(trim(text), ',', ''), '$', '') AS DOUBLE) IS NOT NULL AND regexp_matches(trim(text), '^[$]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?$') AS money FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS text, unnest(range(1, 1 + len(string_split(text, ' ')))) AS i FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(text, '^[$]?[0-9.,]+$')")
def money_words(spark, sf_dir) -> DataFrame:
    """Words of digits, points and commas: which are amounts as a whole."""
    words = t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", " ")).alias("w")).filter(F.col("w").rlike("^[$]?[0-9.,]+$"))
    plain = F.col("w").rlike(r"^[$]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?$")
    return words.select("doc_id", (MF.parse_money(F.col("w")).isNotNull() & plain).alias("money"))


@query("SELECT CAST(o_orderdate AS DATE) AS d, true AS iso, true AS long, false AS other FROM orders GROUP BY 1")
def quote_shows_date(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    said = lambda form: F.concat(F.lit("paid on "), F.date_format("d", form), F.lit(", in full"))
    return d.select("d", TX.shows_date(said("yyyy-MM-dd"), F.col("d")).alias("iso"), TX.shows_date(said("MMMM d, yyyy"), F.col("d")).alias("long"), TX.shows_date(said("yyyy-MM-dd"), F.date_add("d", 1)).alias("other"))


@query(f"SELECT o_orderkey, true AS millions, true AS plain, false AS other FROM orders WHERE {CENTS.format('o_totalprice')} >= 100")
def quote_shows_scaled(spark, sf_dir) -> DataFrame:
    """Amounts of a million times each price, quoted in millions."""
    o = t(spark, sf_dir, "orders").filter("round(cast(o_totalprice as decimal(18,2)) * 100) >= 100").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    quote = F.concat(F.lit("about $"), TX.plain_number(F.col("p")), F.lit(" million"))
    return o.select("o_orderkey", TX.shows_value(quote, F.col("p") * 1_000_000).alias("millions"), TX.shows_value(quote, F.col("p")).alias("plain"), TX.shows_value(quote, F.col("p") * 1_000_000 + 1_000_000).alias("other"))


# Schedules


@query("SELECT x.\"column\", count(v) AS n, CAST(sum(v) AS DECIMAL(38,6)) AS total, CAST(sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS DECIMAL(38,6)) AS plus, CAST(sum(CASE WHEN v < 0 THEN v ELSE 0 END) AS DECIMAL(38,6)) AS minus"
       " FROM (SELECT 'acctbal' AS \"column\", CAST(c_acctbal AS DECIMAL(28,6)) AS v FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey - 10 AS DECIMAL(28,6)) FROM customer) x GROUP BY 1")  # fmt: skip
def column_totals(spark, sf_dir) -> DataFrame:
    c = t(spark, sf_dir, "customer").select("c_name", F.col("c_acctbal").cast("decimal(28,6)").alias("acctbal"), (F.col("c_nationkey") - 10).alias("nation"))
    return schedule.column_totals(c)


_SEQ = (
    f"SELECT o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 2 AS ord, {CENTS.format('o_totalprice')} AS c, false AS total FROM orders"
    f" UNION ALL SELECT o_custkey, count(*) * 2 + 1, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) + CASE WHEN o_custkey % 4 = 0 THEN 7 ELSE 0 END, true FROM orders GROUP BY 1"
)


@query("SELECT o_custkey AS grp, count(*) * 2 + 1 AS ord, CAST(sum(" + CENTS.format("o_totalprice") + ") AS BIGINT) + CASE WHEN o_custkey % 4 = 0 THEN 7 ELSE 0 END AS c, CASE WHEN o_custkey % 4 <> 0 THEN count(*) END AS covers FROM orders GROUP BY o_custkey")
def total_inference(spark, sf_dir) -> DataFrame:
    """Customers' orders with a typed total under them, every fourth of them wrong."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_SEQ)
    return schedule.total_inference(rows, "ord", "c", F.col("total"), ("grp",))


@query("SELECT c_custkey, c_name, CAST((SELECT count(*) FROM customer) - 30 AS BIGINT) AS left_out FROM customer ORDER BY c_custkey LIMIT 30")
def schedule_max_rows(spark, sf_dir) -> DataFrame:
    return schedule.head(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 30)


@query("SELECT n_name AS \"Nation Name\", n_regionkey AS \"Region\" FROM nation")
def schedule_columns(spark, sf_dir) -> DataFrame:
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("Nation Name"), F.col("n_regionkey").alias("Region"))
    return schedule.columns(n, ["nation-name", "Region"])


@query("SELECT CASE n_name WHEN 'NATION_3' THEN 1 WHEN 'NATION_1' THEN 0 ELSE 2 END AS nth, n_nationkey, n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 0) OR n_nationkey IN (1, 3, 5)"
       .replace("CASE n_name WHEN 'NATION_3' THEN 1 WHEN 'NATION_1' THEN 0 ELSE 2 END", "CASE n_nationkey WHEN 5 THEN 0 WHEN 1 THEN 1 ELSE 2 END"))
def schedule_rows_by_label(spark, sf_dir) -> DataFrame:
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    names = {r.n_nationkey: r.n_name for r in n.filter("n_nationkey in (1, 3, 5)").collect()}
    return schedule.rows(n, "n_name", [names[5], names[1].lower().replace("_", " "), names[3]], "n_nationkey")


@query(f"SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN {CENTS.format('o_totalprice')} WHEN o_orderstatus = 'O' THEN {CENTS.format('o_totalprice')} ELSE -{CENTS.format('o_totalprice')} END) AS BIGINT) AS value FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def schedule_computed_cell(spark, sf_dir) -> DataFrame:
    s = t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.sum(cents("o_totalprice")).alias("Total Price"))
    return spark.createDataFrame([(schedule.computed({"status": s}, "label", "[status | F | total price] + [status | O | Total Price] - [status | P | total price]"),)], "value bigint")


@query("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN CAST(sum(" + CENTS.format("o_totalprice") + ") OVER (PARTITION BY o_custkey) AS BIGINT) END AS difference FROM orders")
def difference_on_first_row(spark, sf_dir) -> DataFrame:
    """A group's difference stands on its first row only, so that a column of them adds up."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("c"))
    g = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.sum("c").alias("total"))
    return o.join(g, "o_custkey").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") == F.col("first"), F.col("total")).alias("difference"))


@query("SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS n FROM customer) ORDER BY n NULLS LAST, c_custkey LIMIT 40")
def sort_nulls_last(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("n")).orderBy(F.asc_nulls_last("n"), "c_custkey").limit(40)


@query("SELECT o_custkey, string_agg(concat(o_orderkey, ':', o_orderstatus), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def list_of_structs(spark, sf_dir) -> DataFrame:
    one = F.struct("o_orderkey", "o_orderstatus")
    lists = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("x"))
    return lists.select("o_custkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["o_orderkey"], s["o_orderstatus"])), ",").alias("orders"))


# Periods


@query("SELECT count(*) AS rows, y AS year FROM (SELECT CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-01-29' THEN 1 ELSE 2 END AS y FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-30' AND DATE '1996-01-27') GROUP BY 2")
def declared_years(spark, sf_dir) -> DataFrame:
    years = P.weeks_52_53(spark, date(1994, 1, 30), {1: 52, 2: 52})
    o = t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).filter("d between date'1994-01-30' and date'1996-01-27'")
    return P.by_declared(o, "d", years).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT p AS period, count(*) AS n FROM (SELECT least(13, 1 + date_diff('day', DATE '1994-01-30', CAST(o_orderdate AS DATE)) // 28) AS p FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-30' AND DATE '1995-02-04') GROUP BY 1")
def thirteen_periods(spark, sf_dir) -> DataFrame:
    periods = P.thirteen_periods(P.weeks_52_53(spark, date(1994, 1, 30), {1: 53}))
    o = t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    return o.join(F.broadcast(periods), F.col("d").between(F.col("start"), F.col("end"))).groupBy(F.col("period").cast("bigint").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN g <= 0 THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM (SELECT date_diff('day', last_day(CAST(l_shipdate AS DATE) - INTERVAL 15 DAY), CAST(l_shipdate AS DATE)) AS g FROM lineitem) WHERE g BETWEEN -3 AND 5 GROUP BY 1")
def cutoff_window(spark, sf_dir) -> DataFrame:
    ship = F.to_date("l_shipdate")
    side = P.cutoff(ship, F.last_day(F.date_sub(ship, 15)), 3, 5)
    return t(spark, sf_dir, "lineitem").select(side.alias("side")).filter("side is not null").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT o_custkey AS key, o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 AS e FROM orders), x AS (SELECT key, s, e, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM r) SELECT key, s AS start, e AS \"end\", f AS former_end FROM x WHERE s <= f")
def range_overlaps(spark, sf_dir) -> DataFrame:
    d = F.to_date("o_orderdate")
    return P.overlaps(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), d.alias("start"), F.date_add(d, 20).alias("end")))


@query("SELECT strftime(last_day(d), 'As of %b %-d, %Y') AS snapshot, strftime(date_trunc('month', d), '%b %-d, %Y') || ' to ' || strftime(last_day(d), '%b %-d, %Y') AS flow FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders)")
def flow_and_snapshot_labels(spark, sf_dir) -> DataFrame:
    m = t(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("s")).distinct()
    return m.select(P.flow_label("snapshot", F.col("s"), F.last_day("s")).alias("snapshot"), P.flow_label("flow", F.col("s"), F.last_day("s")).alias("flow"))


# Recorded statements


def _ledger(spark, sf_dir) -> ledger.Ledger:
    book = ledger.Ledger(spark, {"tally_orders": t(spark, sf_dir, "orders"), "tally_customer": t(spark, sf_dir, "customer")})
    book.constant("fee_rate", "number", "0.015")
    book.constant("period_end", "date", "1996-06-30")
    book.constant("status", "text", "F")
    book.create("CREATE TABLE c.paid AS SELECT o_custkey, o_totalprice AS amount FROM tally_orders WHERE o_orderstatus = const_text('status') AND o_orderdate <= const_date('period_end')", "paid orders")
    book.create("CREATE TABLE c.by_nation AS SELECT c_nationkey AS nation, sum(CAST(amount AS DECIMAL(18,2))) AS amount, count(*) AS n FROM c.paid JOIN tally_customer ON c_custkey = o_custkey GROUP BY 1", "paid orders by nation")
    return book


_PAID = "paid AS (SELECT c_nationkey AS nation, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderdate <= DATE '1996-06-30' GROUP BY 1)"


@query(f"WITH {_PAID} SELECT concat('P.', nation) AS id, amount AS value, 'usd' AS unit FROM paid")
def mint_figures(spark, sf_dir) -> DataFrame:
    return _ledger(spark, sf_dir).mint("SELECT concat('P.', nation) AS id, amount AS value, 'usd' AS unit FROM c.by_nation").select("id", "value", "unit")


@query(f"WITH {_PAID} SELECT concat('P.', nation) AS id, amount AS held, amount AS again, 'same' AS verdict FROM paid")
def verify_figures(spark, sf_dir) -> DataFrame:
    book = _ledger(spark, sf_dir)
    book.mint("SELECT concat('P.', nation) AS id, amount AS value, 'usd' AS unit FROM c.by_nation")
    return book.verify()


@query(f"WITH {_PAID} SELECT nation, amount AS value, 'usd' AS unit, 'of all' AS formula, round(amount * 0.015, 2) AS fee FROM paid WHERE nation < 10")
def figure_macros(spark, sf_dir) -> DataFrame:
    book = _ledger(spark, sf_dir)
    book.mint("SELECT concat('P.', nation) AS id, amount AS value, 'usd' AS unit FROM c.by_nation")
    x = spark.sql("SELECT n_nationkey AS nation, cell(concat('P.', n_nationkey), formula => 'of all') AS x, round(fig(concat('P.', n_nationkey)) * const('fee_rate'), 2) AS fee FROM (SELECT id AS n_nationkey FROM range(10))")
    return x.select("nation", "x.value", "x.unit", "x.formula", "fee").filter("value is not null")


@query("SELECT CASE WHEN k % 3 = 0 THEN 'differs' WHEN k % 3 = 1 THEN 'same' ELSE 'gone' END AS verdict, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1 UNION ALL SELECT 'new', 1")
def compare_figures(spark, sf_dir) -> DataFrame:
    """Held amounts against new ones: half a cent is the same, a cent isn't."""
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.col("o_totalprice").cast("double").alias("held"), F.lit("usd").alias("unit"))
    n = t(spark, sf_dir, "orders").filter(k % 3 != 2).select(k.cast("string").alias("id"), (F.col("o_totalprice").cast("double") + F.when(k % 3 == 0, 0.01).otherwise(0.004)).alias("again"))
    more = spark.createDataFrame([("x", 1.0)], "id string, again double")
    return ledger.compared(o, n.unionByName(more)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_STATEMENTS = [
    ("WITH a AS (SELECT * FROM t1) SELECT * FROM a JOIN t2 ON a.k = t2.k", "t1,t2"),
    ("SELECT * FROM x JOIN (WITH x AS (SELECT 1 AS a) SELECT * FROM x) y ON true", "x"),
    ("SELECT k FROM t1 WHERE v IN (SELECT v FROM t2 WHERE EXISTS (SELECT 1 FROM s.t3))", "s.t3,t1,t2"),
    ("SELECT 1 AS one", ""),
]
_LITERALS = [("SELECT v * 1e6 FROM t", "1000000.0"), ("SELECT 0x10 FROM t", "0x10"), ("SELECT v FROM t WHERE y = 2025 AND n < 12", ""), ("SELECT v * 0.15, 365 FROM t WHERE n > 13", "0.15,13"), ("SELECT v FROM t WHERE d > DATE '2025-03-04'", "2025-03-04"), ("WITH a AS (SELECT 77 AS q) SELECT * FROM a", "77")]
_say = lambda pairs: " UNION ALL ".join("SELECT '{}' AS statement, '{}' AS found".format(*(x.replace("'", "''") for x in p)) for p in pairs)


@query(_say(_STATEMENTS))
def statement_read_sets(spark, sf_dir) -> DataFrame:  # noqa: ARG001
    return spark.createDataFrame([(s, ",".join(sorted(lineage.reads(spark, s)))) for s, _ in _STATEMENTS], "statement string, found string")


@query(_say(_LITERALS))
def statement_literals(spark, sf_dir) -> DataFrame:  # noqa: ARG001
    return spark.createDataFrame([(s, ",".join(sorted(lineage.typed_literals(spark, s)))) for s, _ in _LITERALS], "statement string, found string")


QUERIES["prose_backing"], ORACLES["prose_backing"] = QUERIES["prose_backing_all"], ORACLES["prose_backing_all"]
