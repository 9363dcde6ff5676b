"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from tessella.functions.columns import poisson_edges

#: A Poisson count of mean 1 by the draw u.
POISSON = " + ".join(f"(u >= {edge!r})::INT" for edge in poisson_edges())


def solved(name: str, src: str, by: str, y: str, xs: list[str], cluster: str | None = None) -> str:
    """SQL: ``name`` (by, coef, stderr, n, g, r2) of the last of ``xs`` in least squares of y, in each group: each x less its projections on those before it."""
    # A column that doesn't vary, or only with those before it, explains nothing; its own coefficient is null.
    varies = lambda i, over: f"sum(o{i} * o{i}) {over} > 1e-24 * count(*) {over} + 1e-10 * sum({xs[i]} * {xs[i]}) {over}"
    share = lambda c, i: f"CASE WHEN {varies(i, 'OVER q')} THEN sum({c} * o{i}) OVER q / sum(o{i} * o{i}) OVER q ELSE 0 END"
    steps = [f"{name}0 AS (SELECT *, {xs[0]} AS o0 FROM {src})"]
    for j in range(1, len(xs)):
        less = " - ".join(f"o{i} * ({share(xs[j], i)})" for i in range(j))
        steps.append(f"{name}{j} AS (SELECT *, {xs[j]} - {less} AS o{j} FROM {name}{j - 1} WINDOW q AS (PARTITION BY {by}))")
    k = len(xs)
    left = " - ".join(f"o{i} * ({share(y, i)})" for i in range(k))
    steps.append(f"{name}e AS (SELECT *, {y} - {left} AS e FROM {name}{k - 1} WINDOW q AS (PARTITION BY {by}))")
    last = f"o{k - 1}"
    steps.append(f"{name}b AS (SELECT {by}, CASE WHEN {varies(k - 1, "")} THEN sum({y} * {last}) / sum({last} * {last}) END AS coef, sum({last} * {last}) AS oo, count(*) AS n, 1 - sum(e * e) / (sum({y} * {y}) - sum({y}) ** 2 / count(*)) AS r2 FROM {name}e GROUP BY 1)")
    unit = cluster or "row_number() OVER ()"
    steps.append(f"{name}c AS (SELECT {by}, c, sum(s) AS s FROM (SELECT {by}, {unit} AS c, {last} * e AS s FROM {name}e) GROUP BY ALL), {name}m AS (SELECT {by}, sum(s * s) AS m, count(*) AS g FROM {name}c GROUP BY 1)")
    factor = f"g / (g - 1) * (n - 1) / (n - {k})" if cluster else f"n / (n - {k})"
    steps.append(f"{name} AS (SELECT {by}, coef, CASE WHEN coef IS NOT NULL THEN sqrt(m * {factor}) / oo END AS stderr, n, g, r2 FROM {name}b JOIN {name}m USING ({by}))")
    return ", ".join(steps)


def within(src: str, cols: list[str], unit: str, by: str) -> str:
    """SQL: the columns less their unit's and period's means plus the overall mean, in each group."""
    means = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}, {unit}) - avg({c}) OVER (PARTITION BY {by}, t) + avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({means}) FROM {src}"


def every(names: dict[str, str], src: str, y: str, cluster: str) -> str:
    """SQL of (term, coef, stderr, t_value, n_obs, n_clusters) for all columns of least squares; ``names``: column to the term's name. ``src`` has a column ``one``."""
    cols, ctes, rows = list(names), [], []
    for i, c in enumerate(cols):
        ctes.append(solved(f"k{i}_", src, "one", y, [x for x in cols if x != c] + [c], cluster))
        rows.append(f"SELECT '{names[c]}' AS term, round(coef, 6) AS coef, round(stderr, 6) AS stderr, round(coef / stderr, 6) AS t_value, n AS n_obs, g AS n_clusters FROM k{i}_")
    return f"{', '.join(ctes)} {' UNION ALL '.join(rows)}"
