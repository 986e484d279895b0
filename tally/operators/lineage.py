"""Lineage over a reads graph (reader, read), read sets of statements, and input sensitivity."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import cut

MAX_DEPTH = 64


class StatementError(ValueError):
    """A statement that may not be recorded."""


def lineage(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth): all that ``root`` reads, directly or not, at its greatest depth.

    A frontier moves one step at a time and holds each node once a step.
    """
    spark = edges.sparkSession
    front = spark.createDataFrame([(root, 0)], "node string, depth int")
    seen = front
    for step in range(1, MAX_DEPTH):
        front = cut(front.join(edges, F.col("node") == F.col("reader")).select(F.col("read").alias("node")).distinct().withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise StatementError("the reads graph has a cycle, or is deeper than 64")
    return seen.groupBy("node").agg(F.max("depth").alias("depth"))


def closure(edges: DataFrame) -> DataFrame:
    """(reader, read) of all paths, by doubling path lengths."""
    paths = cut(edges.distinct())
    n = paths.count()
    while True:
        more = paths.alias("a").join(paths.alias("b"), F.col("a.read") == F.col("b.reader")).select("a.reader", "b.read")
        paths = cut(paths.unionByName(more).distinct())
        now = paths.count()
        if now == n:
            return paths
        n = now


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _parsed(spark: SparkSession, statement: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)  # noqa: SLF001


def reads(spark: SparkSession, statement: str) -> set[str]:
    """Tables that a statement reads, from Catalyst's parsed plan. A name of a WITH hides a table only where that WITH holds."""
    found: set[str] = set()

    def walk(plan, hidden: frozenset[str]) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            name = plan.multipartIdentifier().mkString(".")
            if name.lower() not in hidden:
                found.add(name)
        if kind == "UnresolvedWith":
            recursive = plan.allowRecursion()
            for relation in _seq(plan.cteRelations()):
                name = relation._1().lower()
                walk(relation._2(), hidden | {name} if recursive else hidden)
                hidden = hidden | {name}
        for child in [*_seq(plan.children()), *_seq(plan.subqueries())]:
            walk(child, hidden)

    walk(_parsed(spark, statement), frozenset())
    return found


def statements(script: str) -> list[str]:
    """The statements of a script, cut at semicolons outside quotes and comments."""
    out, at, start = [], 0, 0
    token = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|;", re.S)
    while m := token.search(script, at):
        at = m.end()
        if m[0] == ";":
            out.append(script[start : m.start()])
            start = at
    out.append(script[start:])
    return [s.strip() for s in out if s.strip()]


def typed_literals(spark: SparkSession, statement: str, declared: frozenset[str] = frozenset()) -> list[str]:
    """Values of a recorded statement that should be named constants, from the parsed plan.

    Numbers: all but whole ones up to 12, 365, 366 and years from 1900 to 2100, however they are written. Dates: all
    but ``declared`` ones and first days of a year.
    """
    found: list[str] = []

    def value(x) -> None:
        if x.getClass().getSimpleName() == "Literal":
            kind, text = x.dataType().simpleString(), x.toString()
            if kind == "date":
                if text not in declared and not text.endswith("-01-01"):
                    found.append(text)
            elif kind in ("tinyint", "smallint", "int", "bigint"):
                n = abs(int(text))
                if not (n <= 12 or n in (365, 366) or 1900 <= n <= 2100):
                    found.append(text)
            elif kind in ("float", "double") or kind.startswith(("decimal", "timestamp", "interval")):
                found.append(text)
        for child in _seq(x.children()):
            value(child)

    def walk(plan) -> None:
        for x in _seq(plan.expressions()):
            value(x)
        if plan.getClass().getSimpleName() == "UnresolvedWith":
            for relation in _seq(plan.cteRelations()):
                walk(relation._2())
        for child in [*_seq(plan.children()), *_seq(plan.subqueries())]:
            walk(child)

    walk(_parsed(spark, statement))
    # 0x10 is read as 0 with a name behind it.
    plain = re.sub(r"'(?:[^']|'')*'", "''", statement)
    return found + re.findall(r"(?<![\w.])0[xX][0-9A-Fa-f]+", plain)


def check_statement(spark: SparkSession, statement: str, known: set[str]) -> set[str]:
    """The read set of a statement that may be recorded; refuses others."""
    kind = re.match(r"\s*(select|with|create\s+(?:or\s+replace\s+)?table\s+\w+\.\w+\s+as\b|comment\s+on\b)", statement, re.I)
    if not kind:
        raise StatementError("only SELECT, CREATE TABLE .. AS SELECT and COMMENT ON can be recorded")
    body = re.sub(r"^\s*create\s+(?:or\s+replace\s+)?table\s+\w+\.\w+\s+as\s+", "", statement, flags=re.I)
    if typed := typed_literals(spark, body):
        raise StatementError(f"typed values: {', '.join(typed)}")
    found = reads(spark, body)
    if unknown := found - known:
        raise StatementError(f"unknown tables: {', '.join(sorted(unknown))}")
    return found


def emptying(spark: SparkSession, tables: dict[str, DataFrame], steps: dict[str, str], figure: str) -> DataFrame:
    """(node, effect): what emptying each input or step, one at a time, does to a figure.

    Each probe replays the chain over views of a session of its own.
    """

    shared = {name: f"tally_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceGlobalTempView(shared[name])  # the table as it is, filters and all

    def value(empty: str | None) -> float | None:
        probe = spark.newSession()
        for name in tables:
            rows = probe.table(f"global_temp.{shared[name]}")
            (rows.limit(0) if name == empty else rows).createOrReplaceTempView(name)
        for name, sql in steps.items():
            step = probe.sql(sql)
            (step.limit(0) if name == empty else step).createOrReplaceTempView(name)
        return probe.sql(figure).first()[0]

    read: dict[str, set[str]] = {n: reads(spark, s) for n, s in steps.items()}
    used = set(reads(spark, figure))
    while more := {r for n in used for r in read.get(n, ())} - used:
        used |= more
    whole = value(None)
    rows = [(n, "not tested" if n not in used else "affects" if value(n) != whole else "no effect") for n in [*tables, *steps]]
    for view in shared.values():
        spark.catalog.dropGlobalTempView(view)
    return spark.createDataFrame(rows, "node string, effect string")
