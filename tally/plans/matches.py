"""Queries of the matcher, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import matching as M
from tally.operators.matching import Rule

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DUCK = fixtures.duck()


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return M.stream(fixtures.book(spark, sf_dir)), M.stream(fixtures.bank(spark, sf_dir))


def unit_sql(source: str, by: tuple[str, ...]) -> str:
    """Items of ``source`` as units, grouped by keys."""
    single = f"SELECT id AS g, [id] AS ids, c, day AS lo, day AS hi, nref, day, entity, ref, batch, text FROM {source}"
    if not by:
        return single
    whole = " AND ".join(f"{k} IS NOT NULL" for k in by)
    one = ", ".join(f"CASE WHEN count(DISTINCT {k}) = 1 AND count({k}) = count(*) THEN max({k}) END AS {k}" for k in ("day", "entity", "ref", "batch"))
    grouped = (
        f"SELECT min(id) AS g, list_sort(list(id)) AS ids, CAST(sum(c) AS BIGINT) AS c, min(day) AS lo, CASE WHEN count(day) = count(*) THEN max(day) END AS hi,"
        f" count(DISTINCT ref) AS nref, {one}, CAST(NULL AS VARCHAR) AS text FROM {source} WHERE {whole} GROUP BY {', '.join(f'{source}.{k}' for k in by)}"
    )
    return f"{grouped} UNION ALL {single} WHERE NOT ({whole})"


def pair_sql(rule: Rule, left: str, right: str) -> str:
    """Candidate pairs of two tables of units."""
    on = [f"l.{k} = r.{k}" for k in rule.on]
    if rule.exact or rule.quote:
        on.append("l.c = r.c")
    else:
        (p0, p1), (t0, t1) = rule.percent or (0, 0), rule.tolerance or (0, 0)
        d = "(r.c - l.c) * sign(l.c)"
        on.append(f"l.c <> 0 AND r.c <> 0 AND {d} >= CAST(abs(l.c) AS DECIMAL(18,0)) * CAST({p0} AS DECIMAL(12,6)) + {t0} AND {d} <= CAST(abs(l.c) AS DECIMAL(18,0)) * CAST({p1} AS DECIMAL(12,6)) + {t1}")
    if rule.days:
        on.append(f"r.hi >= l.lo + ({rule.days[0]}) AND r.lo <= l.hi + ({rule.days[1]})")
    if "ref" not in rule.on:
        on.append("(l.nref = 0 OR r.nref = 0 OR (l.nref = 1 AND r.nref = 1 AND l.ref = r.ref))")
    if rule.quote:
        key = "nullif(regexp_replace(regexp_replace(upper(x), '[^A-Z0-9]', '', 'g'), '^0+([0-9])', '\\1'), '')"
        named = f"SELECT g, {key} AS key FROM (SELECT g, unnest([CASE WHEN nref = 1 THEN ref END, g]) AS x FROM {left}) WHERE x IS NOT NULL"
        said = f"SELECT g, {key} AS key FROM (SELECT g, unnest(regexp_extract_all(upper(coalesce(text, '')), '[A-Z0-9]+')) AS x FROM {right})"
        return (
            f"SELECT DISTINCT l.g AS g_l, r.g AS g_r FROM ({named}) n JOIN ({said}) s ON n.key = s.key JOIN {left} l ON l.g = n.g JOIN {right} r ON r.g = s.g AND {' AND '.join(on)}"
        )
    return f"SELECT DISTINCT l.g AS g_l, r.g AS g_r FROM {left} l JOIN {right} r ON {' AND '.join(on)}"


def step_sql(i: int, rule: Rule, left: str, right: str) -> str:
    """CTEs of one rule: units, pairs, matches, what stays open."""
    return (
        f"lu{i} AS MATERIALIZED ({unit_sql(left, rule.group_left)}), ru{i} AS MATERIALIZED ({unit_sql(right, rule.group_right)}),"
        f" p{i} AS MATERIALIZED ({pair_sql(rule, f'lu{i}', f'ru{i}')}),"
        f" m{i} AS MATERIALIZED (SELECT l.ids AS left_ids, r.ids AS right_ids, l.c AS left_c, r.c AS right_c FROM"
        f" (SELECT *, count(*) OVER (PARTITION BY g_l) AS nl, count(*) OVER (PARTITION BY g_r) AS nr FROM p{i}) p"
        f" JOIN lu{i} l ON l.g = p.g_l JOIN ru{i} r ON r.g = p.g_r WHERE nl = 1 AND nr = 1),"
        f" l{i + 1} AS MATERIALIZED (SELECT * FROM {left} WHERE id NOT IN (SELECT unnest(left_ids) FROM m{i})),"
        f" r{i + 1} AS MATERIALIZED (SELECT * FROM {right} WHERE id NOT IN (SELECT unnest(right_ids) FROM m{i}))"
    )


def resolve_sql(rules: list[Rule]) -> str:
    """CTEs of all rules, then ``items``, ``matches`` and ``reasons``."""
    steps = [step_sql(i, r, f"l{i}" if i else "l", f"r{i}" if i else "r") for i, r in enumerate(rules)]
    matches = " UNION ALL ".join(f"SELECT {i} AS rule_no, '{r.name.replace(chr(39), chr(39) * 2)}' AS rule, left_ids, right_ids, left_c, right_c FROM m{i}" for i, r in enumerate(rules))
    transit = max(0, min((r.days[1] for r in rules if r.days), default=0))
    several = " UNION ALL ".join(
        f"SELECT '{side}' AS side, unnest(u.ids) AS id, {i} AS rule_no, '{r.name.replace(chr(39), chr(39) * 2)}' AS rule, n FROM (SELECT g_{side[0]} AS g, count(*) AS n FROM p{i} GROUP BY 1) q JOIN {side[0]}u{i} u ON u.g = q.g"
        for i, r in enumerate(rules)
        for side in ("left", "right")
    )
    return (
        f"WITH {DUCK}, {', '.join(steps)}, matches AS ({matches}), e AS (SELECT max(day) AS day FROM r),"
        " placed AS (SELECT rule_no, rule, 'left' AS side, unnest(left_ids) AS id FROM matches UNION ALL SELECT rule_no, rule, 'right', unnest(right_ids) FROM matches),"
        f" items AS (SELECT x.*, p.rule, p.rule_no, CASE WHEN p.rule IS NOT NULL THEN 'matched' WHEN x.side = 'left' AND x.day + {transit} > e.day THEN 'in transit' ELSE 'unmatched' END AS status,"
        " e.day - x.day AS age FROM (SELECT 'left' AS side, * FROM l UNION ALL SELECT 'right', * FROM r) x LEFT JOIN placed p ON p.side = x.side AND p.id = x.id, e),"
        f" several AS ({several}), reasons AS (SELECT s.side, s.id, arg_min(s.rule, s.rule_no) AS rule, arg_min(s.n, s.rule_no) AS n"
        " FROM several s JOIN items i ON i.side = s.side AND i.id = s.id WHERE i.status <> 'matched' GROUP BY s.side, s.id)"
    )


def _single(name: str, rule: Rule) -> None:
    """The matches of one rule on all items."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = streams(spark, sf_dir)
        hit = M.mutual(M.units(left, rule.group_left), M.units(right, rule.group_right), rule)
        return hit.select(F.array_join("left_ids", ";").alias("left_ids"), F.array_join("right_ids", ";").alias("right_ids"), M.kind(F.col("left_ids"), F.col("right_ids")).alias("kind"), "left_c", "right_c")

    QUERIES[name] = run
    kind = "concat(CASE WHEN len(left_ids) = 1 THEN '1' ELSE 'n' END, ':', CASE WHEN len(right_ids) = 1 THEN '1' ELSE 'n' END)"
    ORACLES[name] = f"WITH {DUCK}, {step_sql(0, rule, 'l', 'r')} SELECT array_to_string(left_ids, ';') AS left_ids, array_to_string(right_ids, ';') AS right_ids, {kind} AS kind, left_c, right_c FROM m0"


for _name, _rule in {
    "match_exact_reference": Rule("reference", ("ref",), (0, 89)),
    "match_amount_window": Rule("amount and date", (), (0, 2)),
    "match_reference_totals": Rule("reference totals", ("ref",), (0, 89), ("ref",), ("ref",)),
    "match_deposit_lines": Rule("deposit lines", (), (0, 3), (), ("batch",)),
    "match_days_items": Rule("day's items", (), (0, 3), ("entity", "day")),
    "match_tolerance_fee": Rule("fee", ("entity",), (0, 3), percent=(-0.035, -0.015), difference="fee"),
    "match_tolerance_no_key": Rule("cents", (), (0, 3), tolerance=(-50, 50), difference="cents"),
    "match_quoted_text": Rule("quoted", (), (0, 89), quote=True),
    "match_reference_any_date": Rule("reference any date", ("ref",)),
    "match_entity_amount": Rule("entity", ("entity",), (0, 5)),
}.items():
    _single(_name, _rule)


def match_amount_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every left item, counted without listing pairs."""
    left, right = streams(spark, sf_dir)
    return M.counted(M.units(left, ()), M.units(right, ()), Rule("amount", (), (0, 2)), True).select(F.col("g").alias("id"), "n", "partner")


QUERIES["match_amount_window_counts"] = match_amount_window_counts
ORACLES["match_amount_window_counts"] = (
    f"WITH {DUCK}, {step_sql(0, Rule('amount', (), (0, 2)), 'l', 'r')} SELECT g_l AS id, count(*) AS n, CASE WHEN count(*) = 1 THEN max(g_r) END AS partner FROM p0 GROUP BY 1"
)


def match_reference_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal amount in five days, with and without regard to references."""
    left, right = (M.units(x, ()) for x in streams(spark, sf_dir))
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    near = l.join(r, (F.col("l.c") == F.col("r.c"))).filter("r.day - l.day between 0 and 5")
    ok = (F.col("l.nref") == 0) | (F.col("r.nref") == 0) | (F.col("l.ref") == F.col("r.ref"))
    return near.groupBy(ok.alias("allowed")).agg(F.count("*").alias("n"), F.sum("l.c").alias("c"))


QUERIES["match_reference_guard"] = match_reference_guard
ORACLES["match_reference_guard"] = (
    f"WITH {DUCK} SELECT (l.nref = 0 OR r.nref = 0 OR l.ref = r.ref) AS allowed, count(*) AS n, CAST(sum(l.c) AS BIGINT) AS c FROM l JOIN r ON l.c = r.c AND r.day - l.day BETWEEN 0 AND 5 GROUP BY 1"
)

RULES = M.default_rules()
_RESOLVE = resolve_sql(RULES)


def _resolution(spark: SparkSession, sf_dir: str) -> M.Resolution:
    return M.resolve(*streams(spark, sf_dir), RULES)


def resolve_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its status, rule and age."""
    return _resolution(spark, sf_dir).items.select("side", "id", "c", "rule", "status", F.col("age").cast("bigint").alias("age"))


def resolve_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _resolution(spark, sf_dir).matches
    return m.select("rule", F.array_join("left_ids", ";").alias("left_ids"), F.array_join("right_ids", ";").alias("right_ids"), (F.col("right_c") - F.col("left_c")).alias("difference"))


def resolve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciliation: totals, open items and differences, in minor units."""
    return M.summary(_resolution(spark, sf_dir))


def resolve_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_rule(_resolution(spark, sf_dir))


def ambiguity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule by which an open item had candidates, and how many."""
    return _resolution(spark, sf_dir).reasons


def resolve_exceptions_aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items by side, status and age band."""
    open_ = _resolution(spark, sf_dir).items.filter("status <> 'matched'")
    band = F.when(F.col("age") <= 30, "0-30").when(F.col("age") <= 90, "31-90").when(F.col("age") <= 365, "91-365").otherwise("over 365")
    return open_.groupBy("side", "status", band.alias("band")).agg(F.count("*").alias("n"), F.sum("c").alias("c"))


def match_status_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's items by status, with their share of the side."""
    g = _resolution(spark, sf_dir).items.groupBy("side", "status").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    return g.withColumn("share", F.round((F.col("n") / F.expr("sum(n) over (partition by side)")).cast("decimal(20,10)"), 6).cast("double"))


def resolve_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciliation line by line; raises if it doesn't foot."""
    return M.report(_resolution(spark, sf_dir)).summary


def resolve_report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with its criteria, also those that matched nothing."""
    return M.report(_resolution(spark, sf_dir)).by_rule


def resolve_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.report(_resolution(spark, sf_dir)).exceptions.select("side", "id", "c", "in_transit", "reason", "candidates")


QUERIES |= {f.__name__: f for f in (resolve_report, resolve_report_rules, resolve_exceptions)}
ORACLES["resolve_report"] = (
    f"{_RESOLVE}, v AS (SELECT concat(side, '_total') AS line, c FROM items UNION ALL SELECT CASE WHEN side = 'right' THEN 'right_unmatched' WHEN status = 'in transit' THEN 'left_in_transit' ELSE 'left_unmatched' END,"
    " CASE WHEN side = 'left' THEN -c ELSE c END FROM items WHERE status <> 'matched' UNION ALL SELECT 'difference:', right_c - left_c FROM matches WHERE right_c <> left_c),"
    " k AS (SELECT unnest(['left_total', 'left_in_transit', 'left_unmatched', 'right_unmatched', 'right_total']) AS line UNION SELECT line FROM v)"
    " SELECT k.line, count(c) AS items, CAST(coalesce(sum(c), 0) AS BIGINT) AS amount, CAST(coalesce(sum(CASE WHEN c > 0 THEN c END), 0) AS BIGINT) AS plus, CAST(coalesce(sum(CASE WHEN c < 0 THEN c END), 0) AS BIGINT) AS minus"
    " FROM k LEFT JOIN v ON v.line = k.line GROUP BY k.line"
)
_CRITERIA = {  # the default rules, as the survey states them
    "reference": "ref; 0 to 89 days; equal amounts", "reference, totals": "ref; 0 to 89 days; left grouped by ref; right grouped by ref; equal amounts",
    "quoted": "quoted reference; 0 to 89 days; equal amounts", "amount and date": "0 to 2 days; equal amounts",
    "deposit lines": "0 to 2 days; right grouped by batch; equal amounts", "day's items": "0 to 2 days; left grouped by entity and day; equal amounts",
    "day's items, deposit lines": "0 to 2 days; left grouped by entity and day; right grouped by batch; equal amounts",
    "amount, wide": "0 to 89 days; equal amounts", "reference, any date": "ref; any date; equal amounts", "quoted, any date": "quoted reference; any date; equal amounts",
}
_NAMED = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}', '{c}')" for i, (n, c) in enumerate(_CRITERIA.items()))
ORACLES["resolve_report_rules"] = (
    f"{_RESOLVE} SELECT k.rule_no, k.rule, k.criteria, count(m.rule) AS matches, CAST(coalesce(sum(len(left_ids)), 0) AS BIGINT) AS left_items, CAST(coalesce(sum(len(right_ids)), 0) AS BIGINT) AS right_items,"
    " CAST(coalesce(sum(left_c), 0) AS BIGINT) AS left_c, CAST(coalesce(sum(right_c), 0) AS BIGINT) AS right_c, CAST(coalesce(sum(right_c - left_c), 0) AS BIGINT) AS difference"
    f" FROM (VALUES {_NAMED}) k(rule_no, rule, criteria) LEFT JOIN matches m ON m.rule_no = k.rule_no GROUP BY ALL"
)
ORACLES["resolve_exceptions"] = (
    f"{_RESOLVE} SELECT i.side, i.id, i.c, i.status = 'in transit' AS in_transit, coalesce(r.rule, 'no candidate under any rule') AS reason, coalesce(r.n, 0) AS candidates"
    " FROM items i LEFT JOIN reasons r ON r.side = i.side AND r.id = i.id WHERE i.status <> 'matched'"
)

for _f in (resolve_items, resolve_matches, resolve_summary, resolve_by_rule, ambiguity_reasons, resolve_exceptions_aging, match_status_partition):
    QUERIES[_f.__name__] = _f
ORACLES["resolve_items"] = f"{_RESOLVE} SELECT side, id, c, rule, status, age FROM items"
ORACLES["resolve_matches"] = f"{_RESOLVE} SELECT rule, array_to_string(left_ids, ';') AS left_ids, array_to_string(right_ids, ';') AS right_ids, right_c - left_c AS difference FROM matches"
ORACLES["resolve_summary"] = (
    f"{_RESOLVE} SELECT concat(side, ' ', status) AS line, count(*) AS n, CAST(sum(c) AS BIGINT) AS c FROM items GROUP BY side, status"
    " UNION ALL SELECT concat(side, ' total'), count(*), CAST(sum(c) AS BIGINT) FROM items GROUP BY side"
    " UNION ALL SELECT 'differences', count(*), CAST(coalesce(sum(right_c - left_c), 0) AS BIGINT) FROM matches"
)
ORACLES["resolve_by_rule"] = (
    f"{_RESOLVE} SELECT rule_no, rule, count(*) AS matches, CAST(sum(len(left_ids)) AS BIGINT) AS left_items, CAST(sum(len(right_ids)) AS BIGINT) AS right_items,"
    " CAST(sum(left_c) AS BIGINT) AS left_c, CAST(sum(right_c) AS BIGINT) AS right_c FROM matches GROUP BY rule_no, rule"
)
ORACLES["ambiguity_reasons"] = f"{_RESOLVE} SELECT side, id, rule, n FROM reasons"
ORACLES["resolve_exceptions_aging"] = (
    f"{_RESOLVE} SELECT side, status, CASE WHEN age <= 30 THEN '0-30' WHEN age <= 90 THEN '31-90' WHEN age <= 365 THEN '91-365' ELSE 'over 365' END AS band,"
    " count(*) AS n, CAST(sum(c) AS BIGINT) AS c FROM items WHERE status <> 'matched' GROUP BY ALL"
)
ORACLES["match_status_partition"] = (
    f"{_RESOLVE} SELECT side, status, count(*) AS n, CAST(sum(c) AS BIGINT) AS c, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 6) AS share FROM items GROUP BY side, status"
)


def chain_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book items through the bank by reference, and on to the deposits of the same amount."""
    left, right = streams(spark, sf_dir)
    first = M.resolve(left, right, [Rule("reference", ("ref",), (0, 89)), Rule("amount and date", (), (0, 3))])
    second = M.resolve(right, M.stream(fixtures.book(spark, sf_dir)), [Rule("back by entity", ("entity",), (-10, 0))])
    return M.chain(first, second)


_R1 = [Rule("reference", ("ref",), (0, 89)), Rule("amount and date", (), (0, 3))]
QUERIES["chain_trace"] = chain_trace
ORACLES["chain_trace"] = (
    f"WITH {DUCK}, {step_sql(0, _R1[0], 'l', 'r')}, {step_sql(1, _R1[1], 'l1', 'r1')}, {step_sql(5, Rule('b', ('entity',), (-10, 0)), 'r', 'l')},"
    " e1 AS (SELECT left_ids[1] AS a, right_ids[1] AS b, 'reference' AS rule FROM m0 UNION ALL SELECT left_ids[1], right_ids[1], 'amount and date' FROM m1),"
    " e2 AS (SELECT left_ids[1] AS a, right_ids[1] AS b FROM m5)"
    " , s1 AS (SELECT g_l AS id, 'reference' AS rule, 0 AS o FROM p0 UNION ALL SELECT g_l, 'amount and date', 1 FROM p1), w1 AS (SELECT id, arg_min(rule, o) AS why FROM s1 GROUP BY id),"
    " w2 AS (SELECT DISTINCT g_l AS id, 'back by entity' AS why FROM p5)"
    " SELECT l.id, CASE WHEN e2.b IS NOT NULL THEN 'traced' ELSE 'open' END AS status, CASE WHEN e1.b IS NULL THEN 1 WHEN e2.b IS NULL THEN 2 END AS stopped,"
    " CASE WHEN e1.b IS NULL THEN coalesce(w1.why, 'no candidate under any rule') WHEN e2.b IS NULL THEN coalesce(w2.why, 'no candidate under any rule') END AS reason,"
    " coalesce(e2.b, '') AS reaches, CASE WHEN e2.b IS NOT NULL THEN concat(e1.rule, ' > back by entity') ELSE coalesce(e1.rule, '') END AS rules"
    " FROM l LEFT JOIN e1 ON e1.a = l.id LEFT JOIN e2 ON e2.a = e1.b LEFT JOIN w1 ON w1.id = l.id LEFT JOIN w2 ON w2.id = e1.b"
)


def pair_cardinality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a self-join of lineitem on each key would list, from counts alone."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = None
    for key in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"):
        n = items.groupBy(key).count().agg(F.sum(F.col("count") * F.col("count")).cast("bigint").alias("pairs")).select(F.lit(key).alias("key"), "pairs", (F.col("pairs") > M.MAX_PAIRS).alias("refused"))
        out = n if out is None else out.unionByName(n)
    return out


QUERIES["pair_cardinality_guard"] = pair_cardinality_guard
ORACLES["pair_cardinality_guard"] = " UNION ALL ".join(
    f"SELECT '{k}' AS key, CAST(sum(n * n) AS BIGINT) AS pairs, sum(n * n) > {M.MAX_PAIRS} AS refused FROM (SELECT count(*) AS n FROM lineitem GROUP BY {k})" for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
)

# A hand-made assignment with faults in it.
_ASSIGN = """
SELECT 'left' AS side, concat('o', o_orderkey) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'excluded' WHEN o_orderkey % 5 = 0 THEN 'unmatched' ELSE 'matched' END AS status,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS grp, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN NULL WHEN o_orderkey % 91 = 0 THEN NULL ELSE 'p1' END AS pass,
  CASE WHEN o_orderkey % 7 = 0 THEN 'void' END AS reason FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL SELECT 'right', concat('p', o_orderkey), CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'unmatched' ELSE 'matched' END,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'p2' ELSE 'p1' END, NULL
FROM orders WHERE o_orderkey % 89 <> 0
"""
_POPULATIONS = [
    "SELECT concat('o', o_orderkey) AS id, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS c, 'usd' AS unit FROM orders",
    "SELECT concat('p', o_orderkey) AS id, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) - CASE WHEN o_orderkey % 31 = 0 THEN 250 ELSE 0 END AS c, CASE WHEN o_orderkey % 53 = 0 THEN 'eur' ELSE 'usd' END AS unit FROM orders",
]


def _assignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(_ASSIGN), *(spark.sql(p) for p in _POPULATIONS)


def assignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.check_assignment(*_assignment(spark, sf_dir), tolerance=100)


def assignment_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.enrich_assignment(*_assignment(spark, sf_dir)).select("side", "id", "status", "grp", "c", "matched_to", "diff")


_A = f"WITH a AS ({_ASSIGN}), pl AS ({_POPULATIONS[0]}), pr AS ({_POPULATIONS[1]}), p AS (SELECT 'left' AS side, * FROM pl UNION ALL SELECT 'right', * FROM pr)"
QUERIES |= {"assignment_violations": assignment_violations, "assignment_enriched": assignment_enriched}
ORACLES["assignment_violations"] = f"""{_A},
g AS (SELECT grp, count(DISTINCT a.side) AS sides, count(DISTINCT unit) AS units, count(DISTINCT pass) AS passes, sum(CASE WHEN a.side = 'left' THEN c ELSE -c END) AS diff
  FROM a JOIN p ON p.side = a.side AND p.id = a.id WHERE status = 'matched' AND grp IS NOT NULL GROUP BY grp)
SELECT 'lost' AS kind, side, id FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.side = p.side AND a.id = p.id)
UNION ALL SELECT 'foreign', side, id FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE a.side = p.side AND a.id = p.id)
UNION ALL SELECT 'repeated', side, id FROM a GROUP BY side, id HAVING count(*) > 1
UNION ALL SELECT CASE WHEN status = 'matched' THEN 'matched without group or pass' WHEN status = 'excluded' THEN 'excluded without pass or reason' ELSE 'unmatched with group or pass' END, side, id FROM a
  WHERE (status = 'matched' AND (grp IS NULL OR pass IS NULL)) OR (status = 'excluded' AND (pass IS NULL OR reason IS NULL)) OR (status = 'unmatched' AND (grp IS NOT NULL OR pass IS NOT NULL))
UNION ALL SELECT CASE WHEN sides < 2 THEN 'group on one side' WHEN units > 1 THEN 'group of two currencies' WHEN passes > 1 THEN 'group of two passes' ELSE 'group differs' END, 'both', CAST(grp AS VARCHAR)
  FROM g WHERE sides < 2 OR units > 1 OR passes > 1 OR abs(diff) > 100"""
ORACLES["assignment_enriched"] = f"""{_A},
f AS (SELECT a.*, c FROM a JOIN p ON p.side = a.side AND p.id = a.id),
g AS (SELECT grp, coalesce(string_agg(CASE WHEN side = 'left' THEN id END, ';' ORDER BY id), '') AS lids, coalesce(string_agg(CASE WHEN side = 'right' THEN id END, ';' ORDER BY id), '') AS rids,
  CAST(sum(CASE WHEN side = 'left' THEN c ELSE -c END) AS BIGINT) AS diff FROM f WHERE grp IS NOT NULL GROUP BY grp)
SELECT side, id, status, f.grp, c, CASE WHEN side = 'left' THEN rids ELSE lids END AS matched_to, diff FROM f LEFT JOIN g ON g.grp = f.grp"""


# A clean assignment, and the streams that it was made for.
_CLEAN = """
SELECT 'left' AS side, concat('o', o_orderkey) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'excluded' WHEN o_orderkey % 5 = 0 THEN 'unmatched' ELSE 'matched' END AS status,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS grp,
  CASE WHEN o_orderkey % 7 = 0 THEN 'held' WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'less fee' ELSE 'same' END AS pass,
  CASE WHEN o_orderkey % 7 = 0 THEN 'void' END AS reason FROM orders
UNION ALL SELECT 'right', concat('p', o_orderkey), CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'unmatched' ELSE 'matched' END,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'less fee' ELSE 'same' END, NULL FROM orders
"""


def assignment_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a match that was made elsewhere."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    cents = F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    orders = spark.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), cents.alias("c"))
    one = lambda p, c: M.stream(orders.select(F.concat(F.lit(p), "o_orderkey").alias("id"), "date", (c / 100).cast("decimal(18,2)").alias("value")))
    fee = F.when(F.col("o_orderkey") % 31 == 0, 250).otherwise(0)
    r = M.from_assignment(spark.sql(_CLEAN), one("o", F.col("c")), one("p", F.col("c") - fee), [("same", ""), ("less fee", "fee"), ("held", "")], transit=5)
    return M.report(r).summary


QUERIES["assignment_resolution"] = assignment_resolution
ORACLES["assignment_resolution"] = """
WITH o AS (SELECT o_orderkey AS k, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS c, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 31 = 0 THEN 250 ELSE 0 END AS fee, o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 AS free FROM orders),
e AS (SELECT max(d) AS d FROM o),
v AS (SELECT 'left_total' AS line, c FROM o UNION ALL SELECT 'right_total', c - fee FROM o UNION ALL SELECT 'right_unmatched', c - fee FROM o WHERE free
  UNION ALL SELECT CASE WHEN k % 7 <> 0 AND o.d + 5 > e.d THEN 'left_in_transit' ELSE 'left_unmatched' END, -c FROM o, e WHERE free
  UNION ALL SELECT 'difference:fee', -fee FROM o WHERE NOT free AND fee <> 0),
k AS (SELECT unnest(['left_total', 'left_in_transit', 'left_unmatched', 'right_unmatched', 'right_total']) AS line UNION SELECT line FROM v)
SELECT k.line, count(c) AS items, CAST(coalesce(sum(c), 0) AS BIGINT) AS amount, CAST(coalesce(sum(CASE WHEN c > 0 THEN c END), 0) AS BIGINT) AS plus, CAST(coalesce(sum(CASE WHEN c < 0 THEN c END), 0) AS BIGINT) AS minus
FROM k LEFT JOIN v ON v.line = k.line GROUP BY k.line"""
