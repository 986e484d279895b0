from datetime import date

import pytest
from pyspark.sql import functions as F

from tally.functions import money as MF
from tally.functions import periods as P
from tally.operators import control, footing, intervals, lineage
from tally.sources import profile


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_money(spark):
    assert one(spark, MF.money(F.lit(9438108.22))) == "$9,438,108"
    assert one(spark, MF.money(F.lit(-1204.4))) == "($1,204)"
    assert one(spark, MF.figure(F.lit(0.174), F.lit("pct"))) == "17.4%"
    assert one(spark, MF.figure(F.lit(1.26), F.lit("ratio"))) == "1.3x"
    assert one(spark, MF.compact(F.lit(3_240_000))) == "$3.2M"
    assert one(spark, MF.parse_money(F.lit("(€2.25 million)"))) == -2_250_000
    assert one(spark, MF.parse_money(F.lit("none"))) is None


def test_carrying_amount(spark):
    at = F.lit(date(2025, 6, 30))
    left = lambda v, y, m: float(one(spark, MF.carrying_amount(F.lit(v), F.lit(date(y, m, 1)), 12, at)))
    assert (left(100, 2025, 1), left(25.5, 2025, 6), left(200, 2025, 3)) == (50.0, 23.37, 133.33)
    assert one(spark, MF.months_elapsed(F.lit(date(2025, 1, 31)), F.lit(date(2025, 6, 1)))) == 6


def test_periods(spark):
    assert P.parse("fy2025", 9) == ("year", date(2024, 10, 1), date(2025, 9, 30))
    assert P.parse("2026q1") == ("quarter", date(2026, 1, 1), date(2026, 3, 31))
    assert P.parse("fy2025h2", 9) == ("half", date(2025, 4, 1), date(2025, 9, 30))
    assert P.parse("ltm_2025-06") == ("ltm", date(2024, 7, 1), date(2025, 6, 30))
    assert P.parse("ytd_2025-02", 9) == ("ytd", date(2024, 10, 1), date(2025, 2, 28))
    for bad in ("2025", "fy25", "2025-13", "w2025-02-01_2025-01-01"):
        with pytest.raises(P.PeriodError):
            P.parse(bad)
    gap = F.to_timestamp(F.lit("2025-03-09 02:30:00"))
    assert one(spark, P.in_gap(gap, "America/New_York"))
    assert not one(spark, P.in_gap(F.to_timestamp(F.lit("2025-03-09 03:30:00")), "America/New_York"))


def test_formulas(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", -3.5)], "k string, v double")
    texts = ["SUM(v)", 'SUMIFS(v,k,"a")', 'COUNTIFS(v,">0")', "VLOOKUP(v)", "SUM(v)/0", "-(SUM(v)-1)*2"]
    assert [r.value for r in footing.evaluate(df, texts).collect()] == [6.5, 10.0, 1.0, None, None, -11.0]


def test_relations(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 5.0)], "k int, v double")
    b = spark.createDataFrame([(2, 5.1), (1, 0.1 + 1e-16)], "k int, v double")
    assert tuple(control.equal_relations(a, b, ["k"]).first()) == (0, 0, 1, 1)
    twice = a.unionByName(a)
    assert control.result_hash(twice).first().hash != control.result_hash(a).first().hash
    assert control.result_hash(a).first() == control.result_hash(a.orderBy(F.desc("k"))).first()
    assert control.money_scale(spark.createDataFrame([(1.2345,)], "v double"), "v").first().scale == 4
    assert control.money_scale(spark.createDataFrame([(1.12345678,)], "v double"), "v").first().scale is None


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "reader string, read string")
    assert {(r.node, r.depth) for r in lineage.lineage(edges, "a").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert lineage.reads(spark, "WITH x AS (SELECT * FROM room.inv) SELECT * FROM x JOIN t1.billed USING (id)") == {"room.inv", "t1.billed"}
    assert lineage.statements("SELECT ';' -- a;b\n; SELECT 2") == ["SELECT ';' -- a;b", "SELECT 2"]
    assert lineage.typed_literals(spark, "SELECT v * 0.15 FROM t WHERE y = 2025 AND n > 13") == ["0.15", "13"]
    with pytest.raises(lineage.StatementError):
        lineage.check_statement(spark, "DROP TABLE t", {"t"})


def test_ridge():
    import numpy as np

    r = np.random.default_rng(0)
    x = np.c_[np.ones(50), r.normal(size=(50, 2))]
    y = x @ [3.0, 2.0, -1.0]
    eq = [(i, j, float(x[:, i] @ (y if j == 3 else x[:, j]))) for i in range(3) for j in range(i, 4)]
    assert np.allclose(intervals.ridge(eq, 3, 0), [3, 2, -1])


def test_delimiter():
    assert profile.delimiter(["a;b;c", "1;2;3"]) == ";"
    assert profile.delimiter(["plain"]) is None


def test_entry():
    import __spark_entry__ as e

    assert "resolve_summary" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prose_backing_takes_every_number(spark, tmp_path):
    from tally.plans import analytics

    text = "In 2024, 1,204 of 12.50 and 7 or 50,000.4; see 192.0.2.1, 1,2 and 48454"
    spark.createDataFrame([(1, text), (2, None), (3, "7")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(x,) for x in (7, 12, 2024, 50_000, None)], "p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.token: (r.v, r.gap, r.backed) for r in analytics.prose_backing_all(spark, str(tmp_path)).collect()}
    assert set(got) == {"2024", "1,204", "12.50", "7", "50,000.4", "192.0.2.1", "1,2", "48454"}
    assert got["2024"] == (2024.0, 0.0, True) and got["12.50"] == (12.5, 0.5, True) and got["192.0.2.1"] == got["1,2"] == (None, None, None)
    assert got["1,204"] == (1204.0, 820.0, False) and got["48454"] == (48454.0, 1546.0, False) and got["50,000.4"][2]


def test_nearest(spark):
    pool, asked = [3.0, 9.0, 9.5, 700.0], [float(x) for x in range(-5, 1000, 3)] + [9.0, 9.0]
    got = intervals.nearest(spark.createDataFrame([(x,) for x in asked], "v double"), spark.createDataFrame([(x,) for x in pool], "v double"), "v").collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.low == max((x for x in pool if x <= r.v), default=None) and r.high == min((x for x in pool if x >= r.v), default=None)
