"""Queries of events inferred for nations that the registry doesn't cover, from their orders by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import inferred_events as I
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.sources.tables import Stages


def _macro(spark, sf):
    """(cl, t): orders, value, mean price, urgent share, open share, of nations by month."""
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("cl"), month.alias("t"))
    share = lambda cond: F.count_if(cond) / F.count("*")
    m = g.agg(
        F.count("*").cast("double").alias("orders"),
        (F.sum(V.cents("o_totalprice")) / 100.0).alias("value"),
        (F.sum(V.cents("o_totalprice")) / F.count("*") / 100.0).alias("price"),
        share(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        share(F.col("o_orderstatus") == "O").alias("open"),
    )
    return Stages(spark, "macro").cut(m, "panel")


MACRO = """macro AS (SELECT c_nationkey AS cl, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, count(*)::DOUBLE AS orders, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 AS value,
 sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100.0 AS price, count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS urgent, count(*) FILTER (o_orderstatus = 'O') / count(*) AS open
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
CLASSES = {"digital_connectivity": {"net": 1.0}, "innovation_industry": {"capital": 1.0}, "urban_services": {"growth": 1.0}}
SIGNALS = {"net": ("orders", "rise"), "capital": ("value", "rise"), "growth": ("price", "level"), "inflation": ("urgent", "rise")}
MACRO_RULE = I.Rule(SIGNALS, {"net": 0.48, "capital": 0.34, "growth": 0.24}, {"inflation": -0.16}, CLASSES, (0.25, 0.60, 0.25, 0.90), "_objective_macro_proxy")
ANOMALY_RULE = I.Rule(SIGNALS, {"net": 0.50, "capital": 0.32, "growth": 0.18}, {"inflation": -0.12}, CLASSES, (0.25, 0.75, 0.25, 0.98), "_ai_inferred")
INDICATOR_RULE = I.Rule(
    {"net": ("orders", "rise"), "capital": ("value", "rise"), "growth": ("price", "level"), "work": ("open", "fall"), "air": ("urgent", "fall")},
    {"net": 0.34, "capital": 0.29, "work": 0.21, "air": 0.12, "growth": 0.04},
    {},
    CLASSES | {"institutional_reform": {"work": 1.0}, "climate_resilience": {"air": 1.0}},
    (0.28, 0.60, 0.28, 0.93),
    "_objective_indicator_event",
)


def _covered(spark, sf, above: float):
    return V.registry(spark, sf).filter(F.col("intensity") > above).select("cl").distinct()


def _signals(rule: I.Rule) -> str:
    """SQL of the signals' robust scores: z."""
    change = {"rise": "coalesce({0} - lag({0}) OVER w, 0)", "fall": "-coalesce({0} - lag({0}) OVER w, 0)", "level": "{0}"}
    xs = ", ".join(f"{change[how].format(c)} AS x_{s}" for s, (c, how) in rule.signals.items())
    ds = ", ".join(f"x_{s} - quantile_cont(x_{s}, 0.5) OVER p AS d_{s}" for s in rule.signals)
    ms = ", ".join(f"quantile_cont(abs(d_{s}), 0.5) OVER p AS m_{s}, stddev_samp(x_{s}) OVER p AS s_{s}" for s in rule.signals)
    zs = ", ".join(f"coalesce(CASE WHEN m_{s} > 1e-8 THEN d_{s} / (1.4826 * m_{s}) WHEN s_{s} > 1e-8 THEN d_{s} / s_{s} END, 0) AS z_{s}" for s in rule.signals)
    return f"""x AS (SELECT cl, t, {xs} FROM macro WINDOW w AS (PARTITION BY cl ORDER BY t)), d AS (SELECT *, {ds} FROM x WINDOW p AS (PARTITION BY cl)),
m AS (SELECT *, {ms} FROM d WINDOW p AS (PARTITION BY cl)), z AS (SELECT cl, t, {zs} FROM m)"""


def _weighted(rule: I.Rule) -> str:
    return " + ".join([*(f"{w} * z_{s}" for s, w in rule.weights.items()), *(f"{w} * abs(z_{s})" for s, w in rule.size.items())])


def _named(rule: I.Rule) -> str:
    sums = {c: " + ".join(f"{w} * z_{s}" for s, w in ws.items()) for c, ws in rule.classes.items()}
    best = f"greatest({', '.join(sums.values())})"
    return "CASE " + " ".join(f"WHEN {x} = {best} THEN '{c}{rule.suffix}'" for c, x in sums.items()) + " END"


def _rule_sql(rule: I.Rule, above: float, target: float) -> str:
    base, span, least, most = rule.intensity
    parts = ", ".join(f"{{'less': -z_{s}, 'i': {i}, 'text': '{s}:' || format('{{:.2f}}', z_{s})}}" for i, s in enumerate(rule.signals))
    return f"""WITH {V.REGISTRY}, {MACRO}, {_signals(rule)}, known AS (SELECT DISTINCT cl FROM registry WHERE intensity > {above}), n AS (SELECT count(DISTINCT cl) AS n FROM macro),
k AS (SELECT CASE WHEN k / n >= {target} THEN 0 ELSE greatest(ceil({target} * n) - k, 0) END AS needed FROM n, (SELECT count(DISTINCT cl) AS k FROM macro WHERE cl IN (SELECT cl FROM known))),
s AS (SELECT *, {_weighted(rule)} AS score FROM z WHERE t BETWEEN (SELECT min(t) + 2 FROM z) AND (SELECT max(t) - 2 FROM z) AND cl NOT IN (SELECT cl FROM known)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cl ORDER BY round(score, 9) DESC, t) = 1), top AS (SELECT * FROM b QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, cl) <= (SELECT needed FROM k)),
u AS (SELECT *, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 0) AS u FROM top)
SELECT cl, t AS start_t, round(score, 6) AS score, round(least(greatest({base} + {span} * u, {least}), {most}), 6) AS intensity, {_named(rule)} AS name, array_to_string(list_transform(list_sort([{parts}])[1:{rule.drivers}], lambda q: q.text), '|') AS drivers FROM u"""


@query(_rule_sql(INDICATOR_RULE, 0.995, 0.95))
def f14_indicator_events(spark, sf):
    return r(I.rule_events(_macro(spark, sf), _covered(spark, sf, 0.995), INDICATOR_RULE, 0.95), "score", "intensity")


@query(_rule_sql(MACRO_RULE, 0.995, 0.85))
def f15_macro_rule_events(spark, sf):
    return r(I.rule_events(_macro(spark, sf), _covered(spark, sf, 0.995), MACRO_RULE, 0.85), "score", "intensity")


def _distance(table: str, of: str, name: str, names: list[str]) -> str:
    """SQL: ``name``, the squared distance of ``table``'s rows in the metric of the rows ``of`` holds: each column less its regression on those before, over what that leaves."""
    k, ctes = len(names), []
    left = {c: f"{c} - (SELECT avg({c}) FROM {of})" for c in names}
    ctes.append(f"{name}_r0 AS (SELECT *, {', '.join(f'{e} AS r_{i}' for i, e in enumerate(left.values()))} FROM {table}), {name}_f0 AS (SELECT {', '.join(f'{c} - avg({c}) OVER () AS r_{i}' for i, c in enumerate(names))} FROM {of})")
    for j in range(k):
        for part in ("r", "f"):
            later = ", ".join(f"r_{i} - r_{j} * (SELECT sum(r_{i} * r_{j}) / sum(r_{j} * r_{j}) FROM {name}_f{j}) AS r_{i}" for i in range(j + 1, k))
            replaced = f"SELECT * REPLACE ({later}) FROM {name}_{part}{j}" if later else f"SELECT * FROM {name}_{part}{j}"
            ctes.append(f"{name}_{part}{j + 1} AS ({replaced})")
    total = " + ".join(f"r_{j} * r_{j} / (SELECT sum(r_{j} * r_{j}) / (count(*) - 1) FROM {name}_f{k})" for j in range(k))
    ctes.append(f"{name}_t AS (SELECT * EXCLUDE ({', '.join(f'r_{j}' for j in range(k))}), {total} AS {name} FROM {name}_r{k})")
    return ", ".join(ctes)


Z = [f"z_{s}" for s in SIGNALS]
FIRST = " + ".join(f"CASE WHEN s_{c} > 1e-8 THEN ((z.{c} - m_{c}) / (1.4826 * s_{c})) ** 2 ELSE 0 END" for c in Z)
CHI = (I.CHI_MEDIAN[len(Z) - 1], I.CHI_HIGH[len(Z) - 1])
ROBUST = f"""{V.REGISTRY}, {MACRO}, {_signals(ANOMALY_RULE)}, md AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in Z)} FROM z),
mad AS (SELECT {', '.join(f'quantile_cont(abs({c} - m_{c}), 0.5) AS s_{c}' for c in Z)} FROM z, md), a AS (SELECT z.*, {FIRST} AS d0 FROM z, md, mad),
half AS (SELECT * FROM a WHERE d0 <= (SELECT quantile_cont(d0, 0.5) FROM a)), {_distance('a', 'half', 'd1', Z)},
core AS (SELECT * FROM d1_t WHERE d1 <= {CHI[1]} * (SELECT quantile_cont(d1, 0.5) FROM d1_t) / {CHI[0]}), {_distance('d1_t', 'core', 'd2', Z)}, dist AS (SELECT *, sqrt(d2) AS distance FROM d2_t)"""


@query(f"WITH {ROBUST} SELECT cl, t, round(distance, 5) AS distance FROM dist")
def f16_robust_distance(spark, sf):
    return r(I.robust_distance(I.signal_scores(_macro(spark, sf), ANOMALY_RULE), Z).select("cl", "t", "distance"), "distance", digits=5)


@query(f"""WITH {ROBUST}, i AS (SELECT *, {_weighted(ANOMALY_RULE)} AS raw FROM dist), s AS (SELECT *, (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) AS anomaly, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS impulse FROM i),
b AS (SELECT *, least(greatest(0.62 * impulse + 0.38 * anomaly, 0), 1) AS score FROM s WHERE t BETWEEN (SELECT min(t) + 2 FROM z) AND (SELECT max(t) - 2 FROM z) AND cl NOT IN (SELECT cl FROM registry WHERE intensity > 0.995)
 QUALIFY row_number() OVER (PARTITION BY cl ORDER BY round(score, 9) DESC, round(impulse, 9) DESC, t) = 1)
SELECT cl, t AS start_t, round(score, 6) AS score, round(anomaly, 6) AS anomaly, round(least(greatest(0.25 + 0.75 * score, 0.25), 0.98), 6) AS intensity, {_named(ANOMALY_RULE)} AS name FROM b
WHERE (SELECT count(DISTINCT cl) FROM macro WHERE cl IN (SELECT cl FROM registry WHERE intensity > 0.995)) / (SELECT count(DISTINCT cl) FROM macro) < 0.95""")
def f16_anomaly_events(spark, sf):
    return r(I.anomaly_events(_macro(spark, sf), _covered(spark, sf, 0.995), ANOMALY_RULE, 0.95), "score", "anomaly", "intensity")
