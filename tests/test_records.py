"""Cache, schedules, recorded statements, periods and formatting: refusals, and small cases worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tally.functions import money as MF
from tally.functions import periods as P
from tally.functions import text as TX
from tally.operators import arr, ledger, lineage, playbook, schedule
from tally.operators.lineage import StatementError
from tally.sources import cache as C


def test_cache_refuses_and_keeps(spark, tmp_path):
    c = C.Cache(spark, str(tmp_path / "cache"))
    good = spark.createDataFrame([(1, 2.5), (2, 4.0)], "k int, v double")
    facts = c.write("t", good, "a.csv", "v", "a sale", ["k"], stated=6.5, rows=2).first()
    assert (facts.rows, float(facts.total)) == (2, 6.5)
    for wrong in (
        lambda: c.write("T 1", good, "a", "v", "x", ["k"]), lambda: c.write("t", good, "a", "v", " ", ["k"]), lambda: c.write("t", good, "a", "w", "x", ["k"]),
        lambda: c.write("t", good, "a", "v", "x", ["k"], stated=6.4), lambda: c.write("t", good, "a", "v", "x", ["k"], rows=3),
        lambda: c.write("t", good.union(good), "a", "v", "x", ["k"]), lambda: c.write("t", good.withColumn("v", F.lit(None).cast("double")), "a", "v", "x", ["k"]), lambda: c.read("u"),
    ):
        with pytest.raises(C.CacheError):
            wrong()
    assert c.read("t").count() == 2  # what was refused has changed nothing
    c.write("t", good.limit(1), "b.csv", None, "a sale", ["k"])
    assert c.read("t").count() == 1 and c.coordinates().first().file == "b.csv"
    assert c.derive("d", "SELECT k + 1 AS k FROM t", None, "moved", ["k"]).first().k == 2
    assert c.coordinates().filter("id = 'd'").first().derived_from == ["t"]
    for n, text in enumerate(("old", "new")):
        c.note("f", "s", "p. 1", text)
        assert c.notes().count() == 1 and c.notes().first().text == ("old", "new")[n]


def test_items_and_cited_selections(spark, tmp_path):
    c = C.Cache(spark, str(tmp_path / "cache"))
    items = spark.createDataFrame([("left", "a", 1.5, "usd"), ("left", "b", 2.0, "eur"), ("right", "a", -1.0, "usd")], "side string, id string, amount double, unit string")
    assert {(r.side, r.unit, float(r.total)) for r in c.write_items("x", items).collect()} == {("left", "usd", 1.5), ("left", "eur", 2.0), ("right", "usd", -1.0)}
    for wrong in (items.union(items), items.drop("unit"), items.withColumn("amount", F.lit(None).cast("double")), items.withColumn("id", F.lit(" "))):
        with pytest.raises(C.CacheError):
            c.write_items("x", wrong)
    c.write("t", items, "f", "amount", "an item", ["side", "id"])
    rows, cited = c.select("t", "SELECT id FROM t WHERE unit = 'usd join' OR side = 'left' ORDER BY id LIMIT 5")
    assert [r.id for r in rows.collect()] == ["a", "b"] and (cited.first().rows, float(cited.first().total)) == (2, 3.5)
    for query in ("SELECT * FROM t JOIN t", "SELECT id, count(*) FROM t GROUP BY id", "SELECT DISTINCT id FROM t", "WITH a AS (SELECT 1) SELECT * FROM t", "SELECT * FROM t WHERE id IN (SELECT id FROM t)", "SELECT * FROM u", "SELECT 1; SELECT 2"):
        with pytest.raises(C.CacheError):
            c.select("t", query)
    assert C.shell(items.filter("id = 'b'")).splitlines()[2] == "| left | b | 2.0 | eur |"
    assert "over 2 rows" in C.shell(items, rows=2)


def test_ledger(spark):
    t = spark.createDataFrame([("x", 10.0), ("y", 20.5)], "k string, v double")
    book = ledger.Ledger(spark, {"tl": t})
    book.constant("rate", "number", "0.5")
    with pytest.raises(StatementError):
        book.create("CREATE TABLE c.a AS SELECT k, v FROM tl")  # no description
    book.create("CREATE TABLE c.a AS SELECT k, v * const('rate') AS v FROM tl", "halves")
    book.create("CREATE OR REPLACE TABLE c.a AS SELECT k, v * const('rate') AS v FROM tl")
    assert book.descriptions["a"] == "halves"
    for wrong in (
        "CREATE TABLE c.a AS SELECT 1 AS x", "CREATE TABLE main.b AS SELECT k FROM tl", "CREATE OR REPLACE TABLE c.a AS SELECT * FROM c.a", "CREATE TABLE c.b AS SELECT * FROM nowhere",
        "CREATE TABLE c.b AS SELECT v * 1e6 AS v FROM tl", "CREATE TABLE c.b AS SELECT v AS `P.x` FROM tl", "CREATE TABLE c.b AS SELECT const(k) AS v FROM tl", "CREATE TABLE c.b AS SELECT const('none') AS v FROM tl", "DROP TABLE c.a",
    ):
        with pytest.raises(StatementError):
            book.create(wrong, "what")
    mint = "SELECT concat('P.', k) AS id, v AS value, 'usd' AS unit FROM c.a"
    assert {(r.id, r.value) for r in book.mint(mint).collect()} == {("P.x", 5.0), ("P.y", 10.25)}
    for wrong in (
        "SELECT 'a' AS id, v AS value, 'usd' AS unit FROM c.a", "SELECT k AS id, v AS value, 'miles' AS unit FROM c.a", "SELECT k AS id, v AS value FROM c.a",
        "SELECT k AS id, v AS value, 'usd' AS unit, 1 AS extra FROM c.a", "SELECT concat('P.', k) AS id, v AS value, 'eur' AS unit FROM c.a", "SELECT k AS id, fig('none') AS value, 'usd' AS unit FROM c.a",
    ):
        with pytest.raises(StatementError):
            book.mint(wrong)
    assert book.figures.count() == 2
    assert spark.sql("SELECT fig('P.x') + tie('P.y').value AS v").first().v == 15.25
    assert {r.verdict for r in book.verify().collect()} == {"same"}
    t.withColumn("v", F.col("v") + F.when(F.col("k") == "x", 1).otherwise(0)).createOrReplaceTempView("tl")
    book.create("CREATE OR REPLACE TABLE c.a AS SELECT k, v * const('rate') AS v FROM tl")
    assert {(r.id, r.verdict) for r in book.verify().collect()} == {("P.x", "differs"), ("P.y", "same")}
    assert book.reperform(mint).startswith("1. c.a: halves")
    assert ledger.fill("of {P.x}", {"P.x": "$5"}) == "of $5"
    with pytest.raises(StatementError):
        ledger.fill("{P.z}", {})


def test_emptying(spark):
    big = spark.range(10).filter("id > 4")
    got = lineage.emptying(spark, {"ta": big, "tb": spark.range(3), "tc": spark.range(2)}, {"s1": "SELECT id FROM ta", "s2": "SELECT id FROM tb"}, "SELECT count(*) FROM s1 WHERE id NOT IN (SELECT id FROM tc)")
    assert {r.node: r.effect for r in got.collect()} == {"ta": "affects", "tb": "not tested", "tc": "no effect", "s1": "affects", "s2": "not tested"}


def test_schedules(spark):
    t = spark.createDataFrame([(1, "Cash", 5, 2), (2, "Debt", -3, 0), (3, "Total", 2, 2)], "id int, label string, `Amount (usd)` int, n int")
    assert schedule.columns(t).columns == ["label", "Amount (usd)", "n"] and schedule.columns(t, ["amount usd"]).columns == ["Amount (usd)"]
    with pytest.raises(schedule.SelectionError):
        schedule.columns(t, ["nothing"])
    with pytest.raises(schedule.SelectionError):
        schedule.rows(t, "label", ["Cash", "Gold"], "id")
    assert [r.label for r in schedule.rows(t, "label", ["debt", "Cash"], "id").orderBy("nth").collect()] == ["Debt", "Cash"]
    assert schedule.cell(t, "label", "Debt", "n").first().value == 0
    with pytest.raises(schedule.SelectionError):
        schedule.cell(t, "label", "Gold", "n")
    assert schedule.computed({"a": t}, "label", "[a | Cash | n] - [a | Debt | amount usd]") == 5
    with pytest.raises(schedule.SelectionError):
        schedule.computed({"a": t}, "label", "[a | Cash | n] * 2")
    assert schedule.evaluate({"a": "= b * (c + 2) - -1", "b": 3, "c": "=b/2"}) == {"b": 3.0, "c": 1.5, "a": 11.5}
    for wrong in ({"a": "=b", "b": "=a"}, {"a": "=z"}, {"a": "=1 +"}, {"a": "=(1"}, {"a": "=1 $ 2"}):
        with pytest.raises(schedule.SelectionError):
            schedule.evaluate(wrong)
    rows = spark.createDataFrame([(1, 5, False), (2, 7, False), (3, 7, True), (4, 12, True), (5, 1, False), (6, 13, True), (7, 99, True)], "o int, c int, t boolean")
    got = {r.o: r.covers for r in schedule.total_inference(rows, "o", "c", F.col("t")).collect()}
    assert got == {3: 1, 4: 2, 6: 3, 7: None}


def test_texts_as_money_and_dates(spark):
    texts = {"Q3 2025": None, "5 bananas": None, "1.2.3": None, "$1.25 million": 1_250_000, "(£2k)": -2000, "(5": None, "1,20": None, "USD 7": 7, "7 EUR": 7, "−$3.5bn": -3.5e9, "": None}
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", MF.parse_money(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in got} == texts
    shown = spark.createDataFrame([(999_999.0,), (999_949.0,), (999.6,), (-1_500.0,), (0.4,)], "v double").select(MF.compact(F.col("v")).alias("t")).collect()
    assert [r.t for r in shown] == ["$1.0M", "$999.9K", "$1.0K", "($1.5K)", "$0"]
    one = lambda quote, value: spark.createDataFrame([(quote, float(value))], "q string, v double").select(TX.shows_value(F.col("q"), F.col("v")).alias("x")).first().x
    assert one("it is $1.25 million.", 1_250_000) and one("about 12%", 0.12) and not one("$1.25 million", 1_260_000) and one("40k", 40_000)
    day = spark.createDataFrame([("signed 3 March 2025",), ("on 3/3/2025",), ("on 13/3/2025",), ("March 3, 2025!",)], "q string").select(TX.shows_date(F.col("q"), F.lit(date(2025, 3, 3))).alias("x"))
    assert [r.x for r in day.collect()] == [True, True, False, True]


def test_periods(spark):
    years = P.weeks_52_53(spark, date(2024, 1, 1), {1: 52, 2: 53})
    days = spark.createDataFrame([(date(2024, 5, 1),), (date(2025, 12, 1),)], "d date")
    assert {r.year for r in P.by_declared(days, "d", years).collect()} == {1, 2}
    with pytest.raises(P.PeriodError):
        P.by_declared(days.union(spark.createDataFrame([(date(2030, 1, 1),)], "d date")), "d", years)
    four = P.thirteen_periods(years)
    assert four.count() == 26 and four.filter("year = 2 and period = 13").selectExpr("datediff(end, start) + 1 as n").first().n == 35
    short = spark.createDataFrame([(3, date(2024, 1, 1), date(2024, 3, 31))], "year int, start date, end date")
    assert [r.period for r in P.thirteen_periods(short).orderBy("period").collect()] == [1, 2, 3, 4]


def test_bridge_and_spread(spark):
    snap = spark.createDataFrame([("a", date(2024, m, 1), 10) for m in (1, 2, 5)] + [("a", date(2025, 7, 1), 10), ("b", date(2024, 3, 1), 4)], "customer string, month date, arr bigint")
    got = {(str(r.month)[:7], r.movement): r.change for r in arr.bridge(snap).collect()}
    assert got["2024-01", "opening"] == 10 and got["2024-05", "reinstated"] == 10 and got["2025-07", "new"] == 10 and got["2024-03", "new"] == 4 and got["2024-03", "churn"] == -10
    spread = arr.spread(spark.createDataFrame([("a", date(2024, 1, 1), 3, 100)], "customer string, start date, term int, c bigint"))
    assert sorted(r.recognised for r in spread.collect()) == [33, 33, 34]
    assert {str(r.cohort) for r in arr.retention(snap).collect()} == {"2024-01-01", "2024-02-01", "2024-03-01", "2024-05-01"}


def test_playbook():
    after = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}
    assert playbook.waves(after) == [["a"], ["b", "c"], ["d"]]
    assert playbook.decide(after, {"a": "done", "b": "failed"}) == (["c"], ["d"])
    for wrong in ({"a": ["z"]}, {"a": ["b"], "b": ["a"]}):
        with pytest.raises(playbook.PlaybookError):
            playbook.waves(wrong)
    minutes = {"a": 2.0, "b": 3.0, "c": 1.0, "d": 1.0}
    assert playbook.lanes(after, minutes, 2)[1] == 6.0 and playbook.lanes(after, minutes, 1)[1] == 7.0
