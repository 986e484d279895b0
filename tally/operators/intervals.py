"""Usage analytics: last record wins, interval unions, as-of and best-overlap attribution, tiered cost, least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, so it combines on the map side; a hot key is no window partition."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def interval_union(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, islands, covered): merged intervals of each key, and their total length."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.select(key, start, end, F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)).alias("opens"))
    island = opened.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = island.groupBy(key, "island").agg((F.max(end) - F.min(start)).alias("length"))
    return each.groupBy(key).agg(F.count("*").alias("islands"), F.sum("length").alias("covered"))


def asof(events: DataFrame, marks: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """``events`` with the value of the last mark at or before each; before the first mark, the first's.

    Both sides are stacked and sorted once; no pairs are made.
    """
    cols = [c for c in events.columns if c not in (*key, at)]
    left = events.select(*key, at, F.lit(1).alias("tag"), F.struct(*cols).alias("row"), F.lit(None).cast(marks.schema[value].dataType).alias("mark"))
    right = marks.select(*key, at, F.lit(0).alias("tag"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(value).alias("mark"))
    w = Window.partitionBy(*key).orderBy(at, "tag")
    before = F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("mark", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = left.unionByName(right).withColumn("mark", F.coalesce(before, first)).filter("tag = 1")
    return out.select(*key, at, *(F.col(f"row.{c}").alias(c) for c in cols), F.col("mark").alias(value))


def best_overlap(steps: DataFrame, runs: DataFrame, key: str, width: int) -> DataFrame:
    """(key, run, step, overlap): of the steps that a run overlaps, the longest overlap, then the nearest start.

    Both have key, id, s, e. Intervals meet in buckets of ``width``, so the join is on equal keys.
    """
    cut = lambda df, p: df.select(key, F.col("id").alias(f"{p}id"), F.col("s").alias(f"{p}s"), F.col("e").alias(f"{p}e"), F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("bucket"))
    both = cut(steps, "a").join(cut(runs, "b"), [key, "bucket"])
    overlap = F.least("ae", "be") - F.greatest("as", "bs")
    both = both.withColumn("overlap", overlap).filter("overlap > 0")
    best = both.groupBy(key, "bid").agg(F.max(F.struct("overlap", -F.abs(F.col("as") - F.col("bs")), -F.col("aid"))).alias("x"))
    return best.select(key, F.col("bid").alias("run"), (-F.col("x.col3")).alias("step"), F.col("x.overlap").alias("overlap"))


def nearest(asked: DataFrame, pool: DataFrame, v: str) -> DataFrame:
    """``asked`` with low and high: the pool's nearest values at or below and at or above each row's ``v``; null where there is none.

    Both sides are stacked and cut into ranges at quantiles; each range is sorted by itself, and
    what it lacks comes from the nearest ranges that hold a pool value (one row a range).
    """
    spark = asked.sparkSession
    cols = asked.columns
    values = pool.select(F.col(v).cast("double").alias("__v")).filter("__v is not null").distinct()
    both = asked.select(F.col(v).cast("double").alias("__v"), F.struct(*cols).alias("__row"), F.lit(None).cast("double").alias("__pool"))
    both = both.unionByName(values.select("__v", F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), F.col("__v").alias("__pool")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(both.approxQuantile("__v", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cut = lambda x: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= x)) if cuts else F.lit(0)
    ends = {r.at: (r.low, r.high) for r in values.groupBy(cut(F.col("__v")).alias("at")).agg(F.min("__v").alias("low"), F.max("__v").alias("high")).collect()}
    below = [max((ends[j][1] for j in ends if j < i), default=None) for i in range(len(cuts) + 1)]
    above = [min((ends[j][0] for j in ends if j > i), default=None) for i in range(len(cuts) + 1)]
    pick = lambda xs: F.element_at(F.array(*(F.lit(x).cast("double") for x in xs)), F.col("__at") + 1)
    w = Window.partitionBy("__at").orderBy("__v")  # equal values are peers
    low = F.coalesce(F.max("__pool").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), pick(below))
    high = F.coalesce(F.min("__pool").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)), pick(above))
    known = both.filter("__v is not null").withColumn("__at", cut(F.col("__v"))).withColumn("low", low).withColumn("high", high).filter("__row is not null")
    none = both.filter("__v is null and __row is not null").withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    out = known.select("__row", "low", "high").unionByName(none.select("__row", "low", "high"))
    return out.select(*(F.col(f"__row.{c}").alias(c) for c in cols), "low", "high")


def quantile(column: str, q: float) -> Column:
    """With linear interpolation."""
    return F.percentile(column, q)


def normal_equations(df: DataFrame, features: list[Column], target: Column, group: str | None = None) -> DataFrame:
    """(i, j, s): the sums of products of a least-squares fit, from one pass; by group, if any."""
    n = len(features)
    columns = [*features, target]
    sums = [F.sum(columns[i] * columns[j]).alias(f"s_{i}_{j}") for i in range(n) for j in range(i, n + 1)]
    one = df.groupBy(group).agg(*sums) if group else df.agg(*sums)
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("s")) for i in range(n) for j in range(i, n + 1)))
    return one.select(*([group] if group else []), F.explode(cells).alias("x")).select(*([group] if group else []), "x.*")


def ridge(equations: list[tuple[int, int, float]], n: int, penalty: float = 1e-6) -> np.ndarray:
    """Coefficients from the sums of products; the first feature is the constant and is not penalised."""
    a, b = np.zeros((n, n)), np.zeros(n)
    for i, j, s in equations:
        if j == n:
            b[i] = s
        else:
            a[i, j] = a[j, i] = s
    return np.linalg.solve(a + penalty * np.diag([0.0] + [1.0] * (n - 1)), b)
