"""Selections from finished tables, and what their totals are made of. Amounts are whole minor units, rows have an order column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SelectionError(ValueError):
    """A header, label or formula that the table doesn't have."""


def normal(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def find(columns: list[str], header: str) -> str:
    """The column of this very name, else the one whose letters and digits are the same."""
    if header in columns:
        return header
    like = [c for c in columns if normal(c) == normal(header)]
    if len(like) != 1:
        raise SelectionError(f"{header}: {'several columns are' if like else 'no column is'} called so")
    return like[0]


def columns(df: DataFrame, headers: list[str] | None = None, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """The named columns in their order; without names all but ids."""
    return df.select(*([find(df.columns, h) for h in headers] if headers else [c for c in df.columns if c not in ids]))


def rows(df: DataFrame, label: str, labels: list[str], order: str) -> DataFrame:
    """Rows picked by label in the order given, by the exact label or else one of the same letters and digits; a label without a row is refused."""
    wanted = df.sparkSession.createDataFrame([(i, x, normal(x)) for i, x in enumerate(labels)], "nth int, exact string, alike string")
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    hit = df.join(F.broadcast(wanted), (F.col(label) == F.col("exact")) | (plain == F.col("alike")))
    best = F.min_by(F.struct(*df.columns), F.struct(F.col(label) != F.col("exact"), F.col(order))).alias("row")
    picked = hit.groupBy("nth").agg(best)
    if (n := picked.count()) != len(labels):
        raise SelectionError(f"{len(labels) - n} labels have no row")
    return picked.select("nth", "row.*")


def head(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows, each with the number of rows left out."""
    return df.orderBy(order).limit(most).withColumn("left_out", F.lit(max(0, df.count() - most)).cast("bigint"))


def column_totals(df: DataFrame) -> DataFrame:
    """(column, n, total, plus, minus) of every numeric column, in one pass."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    x = lambda c: F.col(c).cast("decimal(28,6)")
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(x(c)).alias("total"), F.sum(F.when(x(c) > 0, x(c)).otherwise(0)).alias("plus"), F.sum(F.when(x(c) < 0, x(c)).otherwise(0)).alias("minus")) for c in numeric]
    return df.agg(*(p.alias(f"c{i}") for i, p in enumerate(parts))).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(parts))))))


def total_inference(df: DataFrame, order: str, amount: str, stated: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """Each row marked as total with ``covers``: how many rows right above it add to it exactly, rows marked so left out; null if none do.

    Sums of the last k rows are differences of running sums, so the row to begin at is looked up, not searched for.
    """
    w = Window.partitionBy(*group).orderBy(order)
    plain = F.when(stated, 0).otherwise(F.col(amount))
    run = df.withColumn("is_total", stated).withColumn("run", F.sum(plain).over(w)).withColumn("nth", F.sum(F.when(stated, 0).otherwise(1)).over(w))
    before = run.filter(~F.col("is_total")).select(*group, (F.col("run") - F.col(amount)).alias("base"), (F.col("nth") - 1).alias("start"))
    need = run.filter("is_total").withColumn("base", F.col("run") - F.col(amount))
    hit = need.join(before, [*group, "base"], "left").filter("start is null or start < nth")
    found = hit.groupBy(*group, order).agg(F.max("start").alias("start"), F.max("nth").alias("nth"), F.max(amount).alias(amount))
    every = need.select(*group, order, amount).join(found.select(*group, order, "start", "nth"), [*group, order], "left")
    return every.select(*group, order, amount, (F.col("nth") - F.col("start")).alias("covers"))


def cell(df: DataFrame, label: str, row: str, column: str) -> DataFrame:
    """(value) of the one cell at a row's label and a column's header; refused if there are none or several."""
    name = find(df.columns, column)
    got = df.filter(F.col(label) == row).select(F.col(name).alias("value"))
    if got.limit(2).count() != 1:
        raise SelectionError(f"{row}: not one row")
    return got


def computed(tables: dict[str, DataFrame], label: str, formula: str) -> int:
    """The value of ``[table | row | column] + [..] - [..]``: one pass a table, whatever the number of its cells."""
    terms = re.findall(r"([+-]?)\s*\[\s*([^|\]]+?)\s*\|\s*([^|\]]+?)\s*\|\s*([^|\]]+?)\s*\]", formula)
    if re.sub(r"[+-]?\s*\[[^\]]*\]|\s", "", formula) or not terms:
        raise SelectionError(f"{formula}: cells, + and - only")
    total = 0
    for name in dict.fromkeys(x[1] for x in terms):
        if name not in tables:
            raise SelectionError(f"no table {name}")
        df = tables[name]
        own = [(s, r, find(df.columns, c)) for s, n, r, c in terms if n == name]
        sums = [F.sum(F.when(F.col(label) == r, F.col(c))).alias(f"v{i}") for i, (_, r, c) in enumerate(own)]
        counts = [F.count_if(F.col(label) == r).alias(f"n{i}") for i, (_, r, _) in enumerate(own)]
        got = df.agg(*sums, *counts).first()
        for i, (sign, r, _) in enumerate(own):
            if got[f"n{i}"] != 1:
                raise SelectionError(f"{r}: not one row")
            total += (-1 if sign == "-" else 1) * got[f"v{i}"]
    return total


def evaluate(cells: dict[str, str | float]) -> dict[str, float]:
    """Values of cells whose formulas (+ - * / and parentheses over names and numbers) name each other, in the order they need; a circle is refused."""
    token = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|([-+*/()]))")
    done: dict[str, float] = {}
    busy: list[str] = []

    def value(name: str) -> float:
        if name in done:
            return done[name]
        if name not in cells:
            raise SelectionError(f"no cell {name}")
        if name in busy:
            raise SelectionError(" -> ".join([*busy[busy.index(name) :], name]))
        busy.append(name)
        held = cells[name]
        done[name] = float(held) if not isinstance(held, str) else formula(held.lstrip("="))
        busy.pop()
        return done[name]

    def formula(text: str) -> float:
        tokens, at = [], 0
        while at < len(text.rstrip()):
            m = token.match(text, at)
            if not m:
                raise SelectionError(f"{text}: can't be read at {text[at:]}")
            tokens.append(m)
            at = m.end()
        place = 0

        def sign() -> str | None:
            return tokens[place][3] if place < len(tokens) else None

        def factor() -> float:
            nonlocal place
            if place >= len(tokens):
                raise SelectionError(f"{text}: ends too soon")
            number, name, s = tokens[place].groups()
            place += 1
            if number:
                return float(number)
            if name:
                return value(name)
            if s == "-":
                return -factor()
            if s == "(":
                inner = chain("+-", lambda: chain("*/", factor))
                if sign() != ")":
                    raise SelectionError(f"{text}: an open parenthesis")
                place += 1
                return inner
            raise SelectionError(f"{text}: {s} is out of place")

        def chain(signs: str, part) -> float:
            nonlocal place
            out = part()
            while (s := sign()) and s in signs:
                place += 1
                other = part()
                out = {"+": out + other, "-": out - other, "*": out * other}[s] if s != "/" else out / other
            return out

        out = chain("+-", lambda: chain("*/", factor))
        if place < len(tokens):
            raise SelectionError(f"{text}: can't be read whole")
        return out

    for name in cells:
        value(name)
    return done
