"""Formulas over columns (SUM, SUMIFS, COUNTIFS), footing tests, and a small selection language for schedules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|"([^"]*)"|([-+*/(),]))')


class _Formula:
    """A recursive-descent parser from a formula to one aggregate Column; None outside the grammar."""

    def __init__(self, text: str, columns: list[str]):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.columns, self.at = columns, 0

    def take(self, what: str | None = None) -> tuple[int, str]:
        if self.at >= len(self.tokens) or (what and self.tokens[self.at] != (4, what)):
            raise ValueError(what)
        self.at += 1
        return self.tokens[self.at - 1]

    def next_is(self, *signs: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] in {(4, s) for s in signs}

    def sum(self) -> Column:
        out = self.product()
        while self.next_is("+", "-"):
            out = out + self.product() if self.take()[1] == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.factor()
        while self.next_is("*", "/"):
            out = out * self.factor() if self.take()[1] == "*" else F.try_divide(out, self.factor())
        return out

    def factor(self) -> Column:
        kind, text = self.take()
        if (kind, text) == (4, "-"):
            return -self.factor()
        if (kind, text) == (4, "("):
            out = self.sum()
            self.take(")")
            return out
        if kind == 1:
            return F.lit(float(text))
        if kind == 2 and text.upper() in ("SUM", "SUMIFS", "COUNTIFS"):
            self.take("(")
            args = [self.take()]
            while self.next_is(","):
                self.take(",")
                args.append(self.take())
            self.take(")")
            return self.call(text.upper(), args)
        raise ValueError(text)

    def column(self, token: tuple[int, str]) -> Column:
        if token[0] != 2 or token[1] not in self.columns:
            raise ValueError(token[1])
        return F.col(token[1])

    def call(self, name: str, args: list[tuple[int, str]]) -> Column:
        value = F.lit(1) if name == "COUNTIFS" else self.column(args.pop(0))
        if len(args) % 2 or (name == "SUM") != (not args):
            raise ValueError(name)
        test = F.lit(True)
        for c, criterion in zip(args[::2], args[1::2], strict=True):
            test = test & _criterion(self.column(c), criterion[1])
        return F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("double")


def _criterion(c: Column, text: str) -> Column:
    sign, value = re.fullmatch(r"(<=|>=|<>|<|>|=)?(.*)", text).groups()
    v = F.lit(float(value)) if re.fullmatch(r"-?\d+(\.\d+)?", value) else F.lit(value)
    return {"<=": c <= v, ">=": c >= v, "<>": c != v, "<": c < v, ">": c > v}.get(sign, c == v)


def formula(text: str, columns: list[str]) -> Column | None:
    """The aggregate that a formula means, or None if it is outside the grammar."""
    try:
        p = _Formula(text.removeprefix("="), columns)
        out = p.sum()
        return out if p.at == len(p.tokens) else None
    except (ValueError, AttributeError):
        return None


def evaluate(df: DataFrame, texts: list[str]) -> DataFrame:
    """(formula, value), all formulas in one pass; null for what is outside the grammar."""
    found = [formula(x, df.columns) for x in texts]
    one = df.agg(*((F.lit(None).cast("double") if f is None else f.cast("double")).alias(f"v{i}") for i, f in enumerate(found)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("formula"), F.col(f"v{i}").alias("value")) for i, x in enumerate(texts)))).alias("x")).select("x.*")


def foots(total: Column, parts: Column, terms: Column, unit: float = 0.01) -> Column:
    """Whether parts add to the total, half a stored unit a term allowed."""
    return F.abs(total - parts) <= terms * unit / 2 + 1e-9 * F.abs(total)


def where(df: DataFrame, tests: dict[str, list[str]]) -> DataFrame:
    """Rows whose value is listed in each named column, or empty there."""
    for c, values in tests.items():
        text = F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        df = df.filter((text == "") | text.isin([v.lower() for v in values]))
    return df


def through(df: DataFrame, order: str, label: str, stop: str) -> DataFrame:
    """Rows up to and with the first labelled ``stop``."""
    last = df.filter(F.col(label) == stop).agg(F.min(order).alias("last"))
    return df.join(F.broadcast(last), F.col(order) <= F.col("last")).drop("last")


def nonzero(df: DataFrame, numbers: list[str], derived: Column | None = None) -> DataFrame:
    """Rows with any shown number that isn't nil to the cent; derived lines stay."""
    some = F.lit(False) if derived is None else derived
    for c in numbers:
        some = some | (F.round(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,6)"), 2) != 0)
    return df.filter(some)


def scaled(df: DataFrame, columns: list[str], power: int) -> DataFrame:
    """Money columns divided by 10**power, never rounded."""
    return df.withColumns({c: F.col(c) / F.lit(10.0**power) for c in columns})
