"""A folder of tables with their coordinates: where each came from, what its rows are, and its control total.

Tables are Parquet; a table's coordinates lie beside it as one JSON row. All is checked before anything is written, and a
table is written beside its place and then moved there, so readers see the old one or the new one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import control as totals

_COORDINATES = "id string, file string, role string, header_at int, rows bigint, columns array<string>, control string, total decimal(38,6), what string, grain array<string>, derived_from array<string>"


class CacheError(ValueError):
    """A table, item or selection that is refused."""


class Cache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)  # noqa: SLF001
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))  # noqa: SLF001

    def _replace(self, df: DataFrame, *place: str) -> None:
        new = f"{self.root}/_new/{uuid.uuid4().hex}"
        df.write.parquet(new)
        target = self._path(*place)
        self._fs.mkdirs(target.getParent())
        self._fs.delete(target, True)
        if not self._fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(new), target):  # noqa: SLF001
            raise CacheError(f"{'/'.join(place)} could not be replaced")

    def write(self, id_: str, df: DataFrame, file: str, control: str | None, what: str, grain: list[str], stated: float | None = None, role: str = "source", header_at: int = 0, rows: int | None = None, derived_from: tuple[str, ...] = ()) -> DataFrame:
        """Checks and writes a table; returns its coordinates.

        Refused: an id that is no plain name, a missing description or grain, a grain whose values repeat, a control
        column with null or non-finite values, a number of rows or a total other than stated.
        """
        if not re.fullmatch(r"[a-z][a-z0-9_]*", id_):
            raise CacheError(f"{id_}: an id is a small letter, then letters, digits and _")
        if not what.strip() or not grain:
            raise CacheError(f"{id_}: say what a row is, and which columns tell rows apart")
        if missing := [c for c in [*grain, *([control] if control else [])] if c not in df.columns]:
            raise CacheError(f"{id_}: no column {', '.join(missing)}")
        t = totals.control_total(df, control).first()
        if t.refused:
            raise CacheError(f"{id_}: {t.refused} values of {control} are null or not finite")
        if rows is not None and rows != t.rows:
            raise CacheError(f"{id_}: {t.rows} rows, {rows} stated")
        if stated is not None and round(float(t.total), 6) != round(float(stated), 6):
            raise CacheError(f"{id_}: total {t.total}, {stated} stated")
        if again := df.groupBy(*grain).count().filter("count > 1").limit(1).collect():
            raise CacheError(f"{id_}: grain repeats at {again[0].asDict()}")
        self._replace(df, "tables", id_)
        facts = self.spark.createDataFrame([(id_, file, role, header_at, t.rows, df.columns, control, t.total, what, grain, list(derived_from))], _COORDINATES)
        self._replace(facts.coalesce(1), "coordinates", id_)
        return facts

    def read(self, id_: str) -> DataFrame:
        if not self._fs.exists(self._path("tables", id_)):
            raise CacheError(f"no table {id_}")
        return self.spark.read.parquet(f"{self.root}/tables/{id_}")

    def coordinates(self) -> DataFrame:
        """One row a table."""
        if not self._fs.exists(self._path("coordinates")):
            return self.spark.createDataFrame([], _COORDINATES)
        return self.spark.read.schema(_COORDINATES).parquet(f"{self.root}/coordinates/*")

    def derive(self, id_: str, query: str, control: str | None, what: str, grain: list[str]) -> DataFrame:
        """A table made by a query over the others, by their ids; their names are kept with it."""
        from tally.operators.lineage import reads

        read = sorted(reads(self.spark, query))
        for name in read:
            self.read(name).createOrReplaceTempView(name)
        self.write(id_, self.spark.sql(query), "", control, what, grain, role="derived", derived_from=tuple(read))
        return self.read(id_)

    # Items: rows that a check works on, each with an id, an amount and a unit.

    def write_items(self, name: str, df: DataFrame) -> DataFrame:
        """(side, unit, n, total) of an item table (side, id, amount, unit, ...), after its rules are checked."""
        check_items(df, name)
        self._replace(df, "items", name)
        return item_totals(self.read_items(name))

    def read_items(self, name: str) -> DataFrame:
        """The items, checked again: the files may have been changed since."""
        df = self.spark.read.parquet(f"{self.root}/items/{name}")
        check_items(df, name)
        return df

    def note(self, file: str, source: str, where: str, text: str) -> None:
        """A remark on what was not extracted; of notes on the same place the last one counts."""
        n = 0 if not self._fs.exists(self._path("notes")) else len(self._fs.listStatus(self._path("notes")))
        one = self.spark.createDataFrame([(n, file, source, where, text)], "n int, file string, source string, where string, text string")
        self._replace(one.coalesce(1), "notes", f"{n:09d}")

    def notes(self) -> DataFrame:
        every = self.spark.read.parquet(f"{self.root}/notes/*")
        return last_notes(every)

    def select(self, id_: str, query: str) -> tuple[DataFrame, DataFrame]:
        """Rows of one table, and (rows, total) of the same rows.

        ``query``: SELECT columns FROM table [WHERE ..] [ORDER BY ..] [LIMIT n], over ``id_`` only; the total is of the
        table's control column.
        """
        if found := refused_clause(query):
            raise CacheError(f"{found} is not allowed in a cited selection")
        m = re.fullmatch(r"\s*select\s+(.*?)\s+from\s+(\w+)(\s+.*)?\s*", query, re.I | re.S)
        if not m or m[2].lower() != id_.lower():
            raise CacheError(f"only SELECT .. FROM {id_} [WHERE ..] [ORDER BY ..] [LIMIT ..]")
        df = self.read(id_)
        df.createOrReplaceTempView(id_)
        fact = self.coordinates().filter(F.col("id") == id_).first()
        same = self.spark.sql(f"SELECT * FROM {id_} {m[3] or ''}")
        cited = totals.control_total(same, fact.control).select("rows", "total")
        return self.spark.sql(query), cited


def refused_clause(query: str) -> str | None:
    """The first clause of a query that a cited selection may not have; quoted text doesn't count."""
    plain = re.sub(r"'(?:[^']|'')*'", "''", query)
    m = re.search(r"\b(join|group\s+by|having|union|intersect|except|distinct|with|over)\b|\(\s*select\b|;", plain, re.I)
    return re.sub(r"\s+", " ", m[0].strip("( ")).upper() if m else None


def span(df: DataFrame, where: Column, control: str) -> DataFrame:
    """(rows, total, refused) of the rows that a condition holds for: nulls count as not."""
    return totals.control_total(df.filter(where), control)


def item_faults(df: DataFrame) -> DataFrame:
    """(fault, n) of an item table."""
    value = F.col("amount").cast("double")
    tests = {"no id": F.col("id").isNull() | (F.trim("id") == ""), "no side": F.col("side").isNull(), "no unit": F.col("unit").isNull(), "no amount": F.col("amount").isNull() | F.isnan(value)}
    one = df.agg(*(F.count_if(c).alias(k) for k, c in tests.items()))
    out = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*(F.col(f"`{k}`") for k in tests)))).alias("fault", "n"))
    again = df.groupBy("side", "id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("id repeated").alias("fault"), "n")
    return out.unionByName(again).filter("n > 0")


def check_items(df: DataFrame, name: str) -> None:
    if missing := {"side", "id", "amount", "unit"} - set(df.columns):
        raise CacheError(f"{name}: no column {', '.join(sorted(missing))}")
    if faults := item_faults(df).collect():
        raise CacheError(f"{name}: " + ", ".join(f"{r.fault} ({r.n})" for r in faults))


def item_totals(df: DataFrame) -> DataFrame:
    """(side, unit, n, total): amounts of different units are never added."""
    return df.groupBy("side", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(28,6)")).alias("total"))


def last_notes(notes: DataFrame) -> DataFrame:
    """Of notes (n, file, source, where, text) on one place, the one with the greatest n."""
    return notes.groupBy("file", "source", "where").agg(F.max_by("text", "n").alias("text"))


def content_hash(df: DataFrame, order: list[str]) -> DataFrame:
    """(rows, sha256) of a table whose rows ``order`` tells apart: equal for equal rows under equal keys.

    Rows are hashed where they lie, dealt by key to parts of about 65,536, hashed there in the order of their
    keys, and the parts' hashes in the order of the parts.
    """
    text = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    keyed = df.select(F.struct(*order).alias("at"), text.alias("h"))
    parts = max(1, -(-df.count() // 65_536))
    joined = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    part = keyed.groupBy(F.pmod(F.xxhash64("at"), F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("n"), joined("at").alias("h"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), joined("part").alias("sha256"))


def shell(df: DataFrame, rows: int = 1000, width: int = 500, size: int = 10_000) -> str:
    """A result as a table in Markdown: types in the head, cells of ``width`` signs at most, the first and last 20 rows if it is longer than ``rows`` or ``size``."""
    got = df.limit(rows + 1).collect()
    clip: Callable[[object], str] = lambda v: "" if v is None else (s if len(s := str(v).replace("|", "\\|").replace("\n", " ")) <= width else s[: width - 1] + "…")
    head = ["| " + " | ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + " |", "|" + "---|" * len(df.columns)]
    lines = ["| " + " | ".join(map(clip, r)) + " |" for r in got[:rows]]
    if len(got) > rows or sum(len(x.encode()) + 1 for x in lines) > size:
        lines = [*lines[:20], "| … |", *lines[-20:]] if len(lines) > 40 else lines
    return "\n".join([*head, *lines, f"{'over ' if len(got) > rows else ''}{min(len(got), rows)} rows"])
