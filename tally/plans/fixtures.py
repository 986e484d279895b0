"""A book and a bank made from orders: deterministic, with every kind of match and mismatch in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOOK_SQL = """
SELECT concat('o', o_orderkey) AS id, CAST(o_orderdate AS DATE) AS date,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN round(CAST(o_totalprice AS DECIMAL(18,2)) / 10000) * 10000 ELSE o_totalprice END AS DECIMAL(18,2)) AS value,
       concat('c', o_custkey) AS entity, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS STRING) END AS ref,
       CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS batch, o_orderkey AS k
FROM orders
"""

_CENTS = "CAST(round(value * 100) AS BIGINT)"
_PART = f"CAST(({_CENTS} * 40 {{div}} 100) / 100 AS DECIMAL(18,2))"
BANK_SQL = f"""
SELECT concat('x', k, 'a') AS id, {{later}} AS date, {_PART} AS value, entity, CAST(NULL AS STRING) AS ref, CAST(NULL AS STRING) AS text, concat('D', k) AS batch
FROM book WHERE k % 17 <> 0 AND k % 11 = 0
UNION ALL SELECT concat('x', k, 'b'), {{later}}, CAST(value - {_PART} AS DECIMAL(18,2)), entity, NULL, NULL, concat('D', k)
FROM book WHERE k % 17 <> 0 AND k % 11 = 0
UNION ALL SELECT concat('x', k), {{later}}, CASE WHEN k % 13 = 0 THEN CAST(({_CENTS} * 97 {{div}} 100) / 100 AS DECIMAL(18,2)) ELSE value END, entity,
       CASE WHEN k % 5 = 0 THEN lpad(CAST(k AS STRING), 9, '0') END, CASE WHEN k % 7 = 0 THEN concat('PAYMENT O', k) END, NULL
FROM book WHERE k % 17 <> 0 AND k % 11 <> 0
UNION ALL SELECT concat('chg', k), {{later}}, CAST(-35.00 AS DECIMAL(18,2)), NULL, NULL, 'SERVICE CHARGE', NULL
FROM book WHERE k % 29 = 0
"""


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(BOOK_SQL)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    book(spark, sf_dir).createOrReplaceTempView("book")
    return spark.sql(BANK_SQL.format(later="date_add(date, CAST(k % 4 AS INT))", div="div"))


def duck() -> str:
    """CTEs l and r of the two streams (id, day, c, entity, ref, batch, text, nref) in DuckDB's SQL."""
    text = lambda s: s.replace("STRING", "VARCHAR")
    key = lambda c: f"nullif(regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '^0+([0-9])', '\\1'), '')"
    side = lambda t: (
        f"SELECT id, datediff('day', DATE '1970-01-01', date) AS day, CAST(round(value * 100) AS BIGINT) AS c, {key('entity')} AS entity, {key('ref')} AS ref,"
        f" {key('batch')} AS batch, text, CASE WHEN {key('ref')} IS NULL THEN 0 ELSE 1 END AS nref FROM {t}"
    )
    later = "CAST(date + CAST(k % 4 AS INTEGER) AS DATE)"
    return f"book AS ({text(BOOK_SQL)}), bank AS ({text(BANK_SQL).format(later=later, div="//")}), l AS ({side('book')}), r AS ({side('bank')})"
