"""Control totals, ties, populations, relation equality, ledger diffs, audits of finished tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def control_total(df: DataFrame, column: str | None = None) -> DataFrame:
    """(rows, total, refused): exact total of a numeric column; refused counts null and non-finite values."""
    if column is None:
        return df.agg(F.count("*").alias("rows"), F.count("*").cast("decimal(38,6)").alias("total"), F.lit(0).cast("bigint").alias("refused"))
    x = F.col(column)
    bad = x.isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        bad = bad | F.isnan(x) | (F.abs(x) == float("inf"))
    exact = F.sum(F.when(~bad, x).cast("decimal(28,6)"))
    return df.agg(F.count("*").alias("rows"), exact.alias("total"), F.count_if(bad).alias("refused"))


def totals_by(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Row count and exact total by keys; amounts of different units are never added."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(amount).cast("decimal(28,6)")).alias("total"))


def money_scale(df: DataFrame, column: str) -> DataFrame:
    """(scale): fewest of 0, 2, 3, 4 and 6 decimals that hold every value; null if none does."""
    x = F.col(column).cast("double")
    out = F.lit(None).cast("int")
    for scale in (6, 4, 3, 2, 0):
        fits = F.max(F.abs(x * 10**scale - F.rint(x * 10**scale))) <= 1e-9 * 10**scale
        out = F.when(fits, scale).otherwise(out)
    return df.agg(out.alias("scale"))


def tie(a: Column, b: Column, tolerance: float | None = None, percent: float | None = None, unit: float = 0.01) -> Column:
    """Whether two figures tie: within an absolute tolerance, a share of b, or both; else half a display unit."""
    gap = F.abs(a - b)
    tests = []
    if tolerance is not None:
        tests.append(gap <= tolerance)
    if percent is not None:
        tests.append(gap <= F.abs(b) * percent)
    out = gap <= unit / 2 if not tests else tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def population(df: DataFrame, exclusions: dict[str, Column]) -> DataFrame:
    """(total_n, included_n, what, n): each row excluded for its first reason, closing exactly."""
    why = F.lit(None).cast("string")
    for what, test in reversed(exclusions.items()):
        why = F.when(test, what).otherwise(why)
    n = df.select(F.coalesce(why, F.lit("included")).alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("total_n"), F.coalesce(F.sum(F.when(F.col("what") == "included", F.col("n"))), F.lit(0)).alias("included_n"))
    return n.crossJoin(F.broadcast(whole)).select("total_n", "included_n", "what", "n")  # one row on the right


def equal_relations(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(only_a, only_b, differ, same): rows by key, numbers within a relative tolerance. Keys are unique."""
    values = [c for c in a.columns if c not in keys]
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys], "full")
    in_a, in_b = F.col(f"x.{keys[0]}").isNotNull(), F.col(f"y.{keys[0]}").isNotNull()
    ok = F.lit(True)
    for c in values:
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        if isinstance(a.schema[c].dataType, T.NumericType):
            ok = ok & (p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q)), F.lit(False)))
        else:
            ok = ok & p.eqNullSafe(q)
    return both.agg(F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b"), F.count_if(in_a & in_b & ~ok).alias("differ"), F.count_if(in_a & in_b & ok).alias("same"))


def ledger_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change): added, removed, moved or unchanged."""
    x = before.select(F.col(key), F.col(value).alias("before"), F.lit(True).alias("in_a"))
    y = after.select(F.col(key), F.col(value).alias("after"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("moved")
    return x.join(y, key, "full").select(key, "before", "after", change.alias("change"))


def result_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): independent of row order; a sum, so that repeated rows count."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def twin_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of rows equal in every shown column."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one statement."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("statements")).filter("statements > 1")


def subtotals(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Rollup over keys; level counts the keys summed over."""
    return df.rollup(*keys).agg(F.sum(F.col(amount).cast("decimal(28,4)")).alias("total"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def walk(df: DataFrame, order: str, amount: str, stated: str) -> DataFrame:
    """Running total against a stated one, by row order inside a table's size (a finished schedule)."""
    running = F.expr(f"sum({amount}) over (order by {order} rows between unbounded preceding and current row)")
    return df.withColumn("running", running).withColumn("foots", F.abs(F.col("running") - F.col(stated)) <= 0.005)


def largest(df: DataFrame, amount: str, order: str, k: int = 25) -> DataFrame:
    """The k rows with the largest absolute amounts in table order, then one row for the rest: its count and sum."""
    ranked = df.orderBy(F.abs(amount).desc(), order).limit(k)
    whole = df.agg(F.count("*").alias("n"), F.sum(amount).alias("s"))
    kept = ranked.agg(F.count("*").alias("kn"), F.sum(amount).alias("ks"))
    rest = whole.crossJoin(kept).select(F.lit(None).cast(df.schema[order].dataType).alias(order), (F.col("s") - F.coalesce("ks", F.lit(0))).alias(amount), (F.col("n") - F.col("kn")).alias("rows"))
    return ranked.select(order, amount, F.lit(1).cast("bigint").alias("rows")).unionByName(rest)
