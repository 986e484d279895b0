"""Recurring revenue: month snapshots, bridges, retention, roots of customer chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def _months(contracts: DataFrame) -> DataFrame:
    last = F.add_months("start", F.col("term") - 1)
    return contracts.withColumn("month", F.explode(F.sequence("start", last, F.expr("interval 1 month"))))


def snapshot(contracts: DataFrame) -> DataFrame:
    """(customer, month, arr) of contracts (customer, start, term, c): in force from the first month to the last, whole months."""
    return _months(contracts).groupBy("customer", "month").agg(F.sum("c").alias("arr"))


def spread(contracts: DataFrame) -> DataFrame:
    """(month, recognised): each contract's amount over its months in whole minor units; the last month has the rest."""
    last = F.col("month") == F.add_months("start", F.col("term") - 1)
    part = F.expr("c div term") + F.when(last, F.expr("c - (c div term) * term")).otherwise(0)
    return _months(contracts).groupBy("month").agg(F.sum(part).alias("recognised"))


def bridge(snap: DataFrame) -> DataFrame:
    """(month, movement, customers, change): opening plus changes is closing.

    The first month measured is the opening base. After it, a customer without revenue the month before is reinstated
    if it had some in the twelve months before, else new.
    Each customer month is stacked with itself moved on by a month, so gaps and ends show without a dense grid.
    """
    opening = snap.agg(F.min("month")).first()[0]
    former = F.lag("month").over(Window.partitionBy("customer").orderBy("month"))
    now = snap.select("customer", "month", F.col("arr").alias("now"), F.lit(0).cast("bigint").alias("before"), former.alias("former"))
    then = snap.select("customer", F.add_months("month", 1).alias("month"), F.lit(0).cast("bigint").alias("now"), F.col("arr").alias("before"), F.lit(None).cast("date").alias("former"))
    m = now.unionByName(then).groupBy("customer", "month").agg(F.sum("now").alias("now"), F.sum("before").alias("before"), F.max("former").alias("former"))
    back = F.col("former") >= F.add_months("month", -12)
    move = (
        F.when((F.col("before") == 0) & (F.col("month") == F.lit(opening)), "opening").when((F.col("before") == 0) & back, "reinstated").when(F.col("before") == 0, "new").when(F.col("now") == 0, "churn")
        .when(F.col("now") > F.col("before"), "expansion").when(F.col("now") < F.col("before"), "contraction").otherwise("unchanged")
    )
    return m.groupBy("month", move.alias("movement")).agg(F.count("*").alias("customers"), F.sum(F.col("now") - F.col("before")).alias("change"))


def retention(snap: DataFrame) -> DataFrame:
    """(cohort, opening, closing, kept, customers, retained) of each month's customers 12 months on; kept is capped a customer.

    Cohorts that aren't twelve months old at the last month measured are withheld.
    """
    end = snap.agg(F.max("month")).first()[0]
    later = snap.select("customer", F.add_months("month", -12).alias("month"), F.col("arr").alias("then"))
    both = snap.filter(F.add_months("month", 12) <= F.lit(end)).join(later, ["customer", "month"], "left").withColumn("closing", F.coalesce("then", F.lit(0)))
    return both.groupBy(F.col("month").alias("cohort")).agg(
        F.sum("arr").alias("opening"), F.sum("closing").alias("closing"), F.sum(F.least("arr", "closing")).alias("kept"), F.count("*").alias("customers"), F.count("then").alias("retained")
    )


def root_parent(edges: DataFrame) -> DataFrame:
    """(id, root) of (id, parent or null), chains of any depth: pointers double each round. A cycle is refused."""
    at = cut(edges.select("id", F.coalesce("parent", "id").alias("root")))
    for _ in range(64):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        if new.join(at, ["id", "root"], "left_anti").isEmpty():
            return new
        at = new
    raise ValueError("the chain of parents has a cycle")
