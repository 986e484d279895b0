"""Recorded statements and the figures they mint: what may be recorded, minting all rows or none, running all again.

Figures are (id, value, unit, statement); constants (id, kind, value). The macros fig, cell, tie and const read both by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage
from .cut import cut
from .lineage import StatementError

REQUIRED, OPTIONAL = ("id", "value", "unit"), ("label", "note")
UNITS = ("usd", "eur", "gbp", "count", "pct", "ratio", "days")
RESERVED = ("catalog", "information_schema", "global_temp", "system", "main")
_FIGURES = "id string, value double, unit string, label string, note string, statement string"
_CONSTANTS = "id string, kind string, value string"


@dataclass
class Ledger:
    """``tables``: the inputs by name; ``schema``: where recorded tables go."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    schema: str = "c"
    statements: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    figures: DataFrame | None = None
    constants: DataFrame | None = None

    def __post_init__(self) -> None:
        self.figures = self.spark.createDataFrame([], _FIGURES)
        self.constants = self.constants or self.spark.createDataFrame([], _CONSTANTS)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        self.define()

    def define(self) -> None:
        """The macros, over the figures and constants as they are now."""
        self.figures.createOrReplaceTempView("figures")
        self.constants.createOrReplaceTempView("constants")
        one = "SELECT first({0}) FROM {1} WHERE id = i"
        make = lambda head, body: self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN ({body})")
        make("fig(i STRING) RETURNS DOUBLE", one.format("value", "figures"))
        make("cell(i STRING, formula STRING DEFAULT NULL) RETURNS STRUCT<id: STRING, value: DOUBLE, unit: STRING, formula: STRING>", "named_struct('id', i, 'value', (SELECT first(value) FROM figures WHERE id = i), 'unit', (SELECT first(unit) FROM figures WHERE id = i), 'formula', formula)")
        make("tie(i STRING) RETURNS STRUCT<id: STRING, value: DOUBLE>", "SELECT first(named_struct('id', id, 'value', value)) FROM figures WHERE id = i")
        make("const(i STRING) RETURNS DOUBLE", "SELECT first(CAST(value AS DOUBLE)) FROM constants WHERE id = i AND kind = 'number'")
        make("const_date(i STRING) RETURNS DATE", "SELECT first(CAST(value AS DATE)) FROM constants WHERE id = i AND kind = 'date'")
        make("const_text(i STRING) RETURNS STRING", "SELECT first(value) FROM constants WHERE id = i AND kind = 'text'")

    def constant(self, id_: str, kind: str, value: str) -> None:
        if kind not in ("number", "date", "text"):
            raise StatementError(f"{id_}: a constant is a number, a date or a text")
        self.constants = self.constants.filter(F.col("id") != id_).unionByName(self.spark.createDataFrame([(id_, kind, value)], _CONSTANTS))
        self.define()

    def allowed(self, statement: str, target: str | None = None) -> set[str]:
        """What a statement reads, if it may be recorded."""
        known = {*self.tables, *(f"{self.schema}.{n}" for n in self.statements), "figures", "constants"}
        found = lineage.check_statement(self.spark, statement, known | ({target} if target else set()))
        if target and target in found:
            raise StatementError(f"{target} reads itself")
        if found & {"figures", "constants"}:
            raise StatementError("figures and constants are read by fig, cell, tie and const")
        plain = re.sub(r"'(?:[^']|'')*'", "''", statement)
        if m := re.search(r"\b(?i:as)\s+`([A-Z]+\.[\w.]+)`", plain):
            raise StatementError(f"{m[1]}: a column's name looks like an id of the ledger")
        for m in re.finditer(r"\b(const(?:_date|_text)?)\s*\(\s*('(?:[^']|'')*'|[^)]*)", statement, re.I):
            name = m[2].strip()
            if not name.startswith("'"):
                raise StatementError(f"{m[1]}: its argument is written out")
            kind = {"const": "number", "const_date": "date", "const_text": "text"}[m[1].lower()]
            if self.constants.filter((F.col("id") == name[1:-1]) & (F.col("kind") == kind)).isEmpty():
                raise StatementError(f"{m[1]}: there is no {kind} {name}")
        return found

    def create(self, statement: str, description: str = "") -> DataFrame:
        """CREATE [OR REPLACE] TABLE c.name AS SELECT .. as a view of that name; its description is kept when it is replaced."""
        m = re.fullmatch(r"\s*create\s+(or\s+replace\s+)?table\s+(\w+)\.(\w+)\s+as\s+(.*)", statement, re.I | re.S)
        if not m:
            raise StatementError("CREATE [OR REPLACE] TABLE schema.name AS SELECT ..")
        replace, schema, name, body = m.groups()
        if schema.lower() in RESERVED or schema != self.schema:
            raise StatementError(f"{schema}: tables go to {self.schema}")
        if name in self.statements and not replace:
            raise StatementError(f"{schema}.{name} is there already")
        if not (description.strip() or self.descriptions.get(name)):
            raise StatementError(f"{schema}.{name}: say what it holds")
        self.allowed(statement, f"{schema}.{name}")
        df = self.view(body)
        df.createOrReplaceTempView(f"{schema}_{name}")
        self.statements[name] = body
        self.descriptions[name] = description.strip() or self.descriptions[name]
        return df

    def view(self, body: str) -> DataFrame:
        """A query over inputs and recorded tables."""
        return self.spark.sql(re.sub(rf"\b{self.schema}\.(\w+)\b", rf"{self.schema}_\1", body))

    def mint(self, statement: str) -> DataFrame:
        """The figures of a query's rows, all of them or, with a fault in any, none."""
        self.allowed(statement)
        rows = self.view(statement)
        if missing := [c for c in REQUIRED if c not in rows.columns]:
            raise StatementError(f"no column {', '.join(missing)}")
        if extra := [c for c in rows.columns if c not in (*REQUIRED, *OPTIONAL)]:
            raise StatementError(f"columns that figures don't have: {', '.join(extra)}")
        full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (*REQUIRED, *OPTIONAL))).withColumn("statement", F.lit(statement))
        full = full.withColumn("value", F.col("value").cast("double"))
        value = F.col("value")
        tests = {"no id": F.col("id").isNull(), "no value": value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "unknown unit": F.col("unit").isNull() | ~F.col("unit").isin(*UNITS)}
        n = full.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), *(F.count_if(t).alias(k) for k, t in tests.items())).first().asDict()
        faults = [f"{k} ({n[k]})" for k in tests if n[k]]
        if n["ids"] < n["rows"] - n["no id"]:
            faults.append("an id twice")
        if not full.join(self.figures.filter(F.col("statement") != statement).select("id"), "id", "left_semi").isEmpty():
            faults.append("an id that another statement minted")
        if faults:
            raise StatementError("; ".join(faults))
        # Kept as rows: what a statement gives later is for verify to find out.
        self.figures = cut(self.figures.filter(F.col("statement") != statement).unionByName(full.select(*self.figures.columns)))
        self.define()
        return self.figures.filter(F.col("statement") == statement)

    def verify(self) -> DataFrame:
        """(id, held, again, verdict): every statement run anew, once each, against what it minted."""
        out = None
        for (statement,) in self.figures.select("statement").distinct().orderBy("statement").collect():
            new = self.view(statement).select("id", F.col("value").cast("double").alias("again"))
            held = self.figures.filter(F.col("statement") == statement).select("id", F.col("value").alias("held"), "unit")
            one = compared(held, new)
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "id string, held double, again double, verdict string")

    def reperform(self, statement: str) -> str:
        """What to run, in order, to have a statement's figures again."""
        steps: list[str] = []

        def before(body: str) -> None:
            for name in sorted(lineage.reads(self.spark, body)):
                own = name.rpartition(".")[2]
                if name.startswith(f"{self.schema}.") and own not in steps:
                    before(self.statements[own])
                    steps.append(own)

        before(statement)
        made = [f"{i}. {self.schema}.{n}: {self.descriptions[n]}\n   {self.statements[n].strip()}" for i, n in enumerate(steps, 1)]
        return "\n".join([*made, f"{len(steps) + 1}. figures\n   {statement.strip()}"])


def compared(held: DataFrame, new: DataFrame) -> DataFrame:
    """(id, held, again, verdict) of figures (id, held, unit) and their values now (id, again).

    Money agrees within half a minor unit, counts when rounded, others within 1e-9 of the value.
    """
    both = held.join(new, "id", "full")
    gap, unit = F.abs(F.col("held") - F.col("again")), F.col("unit")
    same = F.when(unit.isin("usd", "eur", "gbp"), gap < 0.005).when(unit == "count", F.round("held") == F.round("again")).otherwise(gap <= 1e-9 * F.greatest(F.abs("held"), F.abs("again"), F.lit(1.0)))
    verdict = F.when(F.col("again").isNull(), "gone").when(F.col("held").isNull(), "new").when(same, "same").otherwise("differs")
    return both.select("id", "held", "again", verdict.alias("verdict"))


def fill(template: str, figures: dict[str, str]) -> str:
    """A text with {id} replaced by the figure's text; an unknown id is refused."""

    def put(m: re.Match) -> str:
        if m[1] not in figures:
            raise StatementError(f"no figure {m[1]}")
        return figures[m[1]]

    return re.sub(r"\{([A-Za-z][\w.]*)\}", put, template)
