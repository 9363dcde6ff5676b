"""From a registry of interval events to treatment designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clip, minmax, norm_key, rank_pct, safe_div

NEVER = 9999


def keyword_class(text: Column, rules: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first class any of whose words the lower-cased text holds."""
    low, kind = F.lower(text), F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        kind = F.when(hit, name).otherwise(kind)
    return kind


def keyword_scores(df: DataFrame, text: str, classes: dict[str, list[str]]) -> DataFrame:
    """Hits of each class's words among the text's words, and the class of most hits (ties: the first; none: null)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    among = lambda ws: F.filter(words, lambda w: w.isin(ws))
    hits = {c: F.size(among(ws)).alias(f"hits_{c}") for c, ws in classes.items()}
    scored = df.select("*", *hits.values())
    best = F.greatest(*[F.col(f"hits_{c}") for c in classes])
    return scored.withColumn("best", F.when(best > 0, F.coalesce(*[F.when(F.col(f"hits_{c}") == best, c) for c in classes])))


def evidence_grade(source: Column, amount: Column) -> tuple[Column, Column]:
    """Grade A, B or C by source and size, and its score."""
    grade = F.when((source == "F") & (amount >= 0.8), "A").when(source.isin("F", "O"), "B").otherwise("C")
    return grade, F.when(grade == "A", 1.0).when(grade == "B", 0.6).otherwise(0.3)


def expand_intervals(registry: DataFrame) -> DataFrame:
    """A row for each event and period from start to end; is_new in the first. Intervals that end before they start have none."""
    ok = registry.filter("end_t >= start_t")
    return ok.select("*", F.explode(F.sequence("start_t", "end_t")).alias("t")).withColumn("is_new", (F.col("t") == F.col("start_t")).cast("int"))


def period_intensity(registry: DataFrame, kinds: list[str]) -> DataFrame:
    """By cluster and period: running events, new events, total intensity, intensity by kind, the dominant kind."""
    x = expand_intervals(registry)
    by = [F.sum(F.when(F.col("kind") == k, F.col("intensity")).otherwise(0.0)).alias(f"intensity_{k}") for k in kinds]
    g = x.groupBy("cl", "t").agg(F.count("*").alias("events"), F.sum("is_new").alias("new_events"), F.sum("intensity").alias("intensity"), *by)
    best = F.greatest(*[F.col(f"intensity_{k}") for k in kinds])
    return g.withColumn("dominant", F.when(best > 0, F.coalesce(*[F.when(F.col(f"intensity_{k}") == best, k) for k in kinds])))


def cohorts(registry: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """The first start of each cluster among the events of each variant."""
    return registry.groupBy("cl").agg(*[F.min(F.when(cond, F.col("start_t"))).alias(f"cohort_{name}") for name, cond in variants.items()])


def intense_cohort(registry: DataFrame, top: int) -> DataFrame:
    """The ``top`` clusters of highest peak period intensity, with the period of the peak."""
    g = expand_intervals(registry).groupBy("cl", "t").agg(F.sum("intensity").alias("intensity"))
    peak = g.groupBy("cl").agg(F.max(F.struct(F.round("intensity", 9).alias("intensity"), (-F.col("t")).alias("nt"))).alias("p"))
    return peak.select("cl", F.col("p.intensity").alias("peak"), (-F.col("p.nt")).alias("peak_t")).orderBy(F.col("peak").desc(), "cl").limit(top)


def rollout(panel: DataFrame, cohort: DataFrame) -> DataFrame:
    """treated, cohort (9999: never), post and did of each row, by its cluster's cohort."""
    j = panel.join(cohort.select("cl", F.col("cohort").alias("_c")), "cl", "left").withColumn("cohort", F.coalesce("_c", F.lit(NEVER))).drop("_c")
    treated, post = (F.col("cohort") < NEVER).cast("int"), (F.col("t") >= F.col("cohort")).cast("int")
    return j.select("*", treated.alias("treated"), post.alias("post"), (treated * post).alias("did"))


def salience(first_rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted rank shares inside the cluster, and the unit's rank and number there."""
    w = Window.partitionBy("cl")
    score = sum((rank_pct(F.col(c), w) * k for c, k in weights.items()), F.lit(0.0))
    s = first_rows.withColumn("salience", score)
    return s.select("unit", "cl", "salience", F.row_number().over(w.orderBy(F.round("salience", 9).desc(), "unit")).alias("rank"), F.count("*").over(w).alias("units"))


def doses(did_panel: DataFrame, intensity: DataFrame) -> DataFrame:
    """Dose (post times intensity), the cluster's peak and mean dose, its active periods, change of events."""
    j = did_panel.join(intensity.select("cl", "t", "intensity", "events"), ["cl", "t"], "left").fillna({"intensity": 0.0, "events": 0})
    d = j.withColumn("dose", F.col("post") * F.col("intensity"))
    w, own = Window.partitionBy("cl"), Window.partitionBy("unit").orderBy("t")
    return d.select("unit", "cl", "t", "dose", F.max("dose").over(w).alias("peak_dose"), F.avg("dose").over(w).alias("mean_dose"), F.sum((F.col("dose") > 0).cast("long")).over(w).alias("active"), (F.col("events") - F.lag("events").over(own)).alias("event_delta"))


def indicator_breaks(panel: DataFrame, covered: DataFrame) -> DataFrame:
    """For clusters not covered: the period of the largest robust z of the change of the value, if above 1, with intensity scaled to 0..1."""
    own, w = Window.partitionBy("cl").orderBy("t"), Window.partitionBy("cl")
    d = panel.join(covered, "cl", "left_anti").withColumn("d", F.col("value") - F.lag("value").over(own))
    d = d.withColumn("dev", F.col("d") - F.percentile("d", 0.5).over(w))
    z = d.withColumn("z", safe_div(F.col("dev"), 1.4826 * F.percentile(F.abs("dev"), 0.5).over(w)))
    best = z.filter("z IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("cl").orderBy(F.col("z").desc(), "t"))).filter("_r = 1 AND z > 1")
    return best.select("cl", F.col("t").alias("start_t"), "z", F.least(F.lit(1.0), F.col("z") / 5).alias("intensity"))


def sustained_jump(panel: DataFrame, threshold: float) -> DataFrame:
    """The first period whose growth and the next row's are at or above the threshold; null if none."""
    own = Window.partitionBy("unit").orderBy("t")
    g = panel.withColumn("g", safe_div(F.col("value"), F.lag("value").over(own)) - 1)
    held = g.withColumn("_n", F.lead("g").over(own))
    return held.groupBy("unit").agg(F.min(F.when((F.col("g") >= threshold) & (F.col("_n") >= threshold), F.col("t"))).alias("cohort"))


def jump_design(panel: DataFrame, at: int) -> DataFrame:
    """Treated: mean from ``at`` on less mean before is in the top quarter of units."""
    u = panel.groupBy("unit").agg((F.avg(F.when(F.col("t") >= at, F.col("value"))) - F.avg(F.when(F.col("t") < at, F.col("value")))).alias("jump"))
    top = u.agg(F.percentile("jump", 0.75)).first()[0]
    return u.withColumn("treated", (F.col("jump") >= F.lit(top)).cast("int"))


def schedule(panel: DataFrame) -> DataFrame:
    """Each unit's cohort: its cohort column, else its first period with did = 1, else never."""
    return panel.groupBy("unit").agg(F.coalesce(F.min(F.when(F.col("cohort") < NEVER, F.col("cohort"))), F.min(F.when(F.col("did") == 1, F.col("t"))), F.lit(NEVER)).alias("cohort"))


def timing_ready(panel: DataFrame, low: int, high: int, least: int) -> DataFrame:
    """Periods inside the window; cohorts in it with ``least`` units or more stay, others become never treated."""
    units = panel.select("unit", "cohort").distinct()
    good = units.filter(F.col("cohort").between(low, high)).groupBy("cohort").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    j = panel.filter(F.col("t").between(low, high)).join(good.select(F.col("cohort").alias("_c")), F.col("cohort") == F.col("_c"), "left")
    cohort = F.coalesce("_c", F.lit(NEVER))
    return j.select("unit", "t", "value", cohort.alias("cohort"), (F.col("t") >= cohort).cast("int").alias("did"))


def registry_audit(registry: DataFrame, clusters: int) -> DataFrame:
    """Events, clusters and their share of all, by kind and in total (kind null)."""
    g = registry.groupingSets([("kind",), ()], "kind").agg(F.count("*").alias("events"), F.countDistinct("cl").alias("clusters"), F.avg("intensity").alias("mean_intensity"))
    return g.withColumn("coverage", F.col("clusters") / F.lit(float(clusters)))


def switch_variant(df: DataFrame, suffix: str) -> DataFrame:
    """Columns with the suffix take their plain names' place."""
    new = {c.removesuffix(suffix): c for c in df.columns if c.endswith(suffix)}
    return df.select(*[F.col(new[c]).alias(c) if c in new else F.col(c) for c in df.columns if c not in new.values()])


def resolve_codes(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cl, how) for every row of ``rows`` (id, codes, name, region): each cluster whose code is among the row's codes; for rows without any, those
    whose name is the row's; for rows without these, those of the row's region; else null and ``unresolved``. ``clusters``: cl, code, name, region.
    """
    code = rows.select("id", F.explode(F.array_distinct(F.split(F.upper("codes"), "[^A-Z0-9]+"))).alias("k"), F.lit(1).alias("level"))
    name = rows.select("id", norm_key(F.col("name")).alias("k"), F.lit(2).alias("level"))
    region = rows.select("id", norm_key(F.col("region")).alias("k"), F.lit(3).alias("level"))
    keys = [clusters.select("cl", F.upper("code").alias("k"), F.lit(1).alias("level")), clusters.select("cl", norm_key(F.col("name")), F.lit(2)), clusters.select("cl", norm_key(F.col("region")), F.lit(3))]
    met = code.union(name).union(region).filter("k <> ''").join(keys[0].union(keys[1]).union(keys[2]), ["k", "level"], "inner").select("id", "cl", "level").distinct()
    best = met.withColumn("best", F.min("level").over(Window.partitionBy("id"))).filter("level = best")
    how = F.when(F.col("level") == 1, "code").when(F.col("level") == 2, "name").when(F.col("level") == 3, "region").otherwise("unresolved")
    return rows.select("id").distinct().join(best.select("id", "cl", "level"), "id", "left").select("id", "cl", how.alias("how"))


def project_events(projects: DataFrame, refs: int = 6) -> DataFrame:
    """Projects (cl, t, name, cents, project) as events by cluster, period and name: amount, distinct projects, the first ``refs`` of them by name joined by bars, and
    intensity: .75 of the log amount and .25 of the projects, each scaled to 0..1 in the cluster (1 if constant), within .05 to 1.

    Events stay that are of the cluster's 55 % quantile of amounts or more, or of two projects or more; all, if none would.
    """
    key = ["cl", "t", "name"]
    once = projects.groupBy(*key, F.col("project").cast("string").alias("project")).agg(F.sum("cents").alias("cents"))
    placed = once.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("project")))
    named = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= refs, F.col("project")))), "|")
    g = placed.groupBy(*key).agg((F.sum("cents") / 100.0).alias("amount"), F.count("*").alias("projects"), named.alias("refs"))
    w = Window.partitionBy("cl")
    scaled = 0.75 * minmax(F.log1p("amount"), w, 1.0) + 0.25 * minmax(F.col("projects").cast("double"), w, 1.0)
    g = g.withColumn("intensity", clip(scaled, 0.05, 1.0)).withColumn("_q", F.percentile("amount", 0.55).over(w))
    kept = g.filter((F.col("amount") >= F.col("_q")) | (F.col("projects") >= 2))
    return (g if kept.isEmpty() else kept).drop("_q")


#: Tracks of treatment in the order they are tried: (name, whose cohorts, least and most share of the panel's clusters); fixed values.
TRACKS = (
    ("direct_core", "core", 0.08, 0.70),
    ("external_direct", "external", 0.05, 0.70),
    ("direct_non_ai_fallback", "all", 0.05, 0.80),
    ("external_direct_high_coverage_fallback", "external", 0.0, 1.0),
    ("direct_non_ai_fallback", "all", 0.0, 1.0),
)


def core_design(registry: DataFrame, panel: DataFrame, cap: int, threshold: float = 0.7, fallback: float = 0.6, tracks: tuple = TRACKS) -> DataFrame:
    """(cl, cohort, track) of the principal track. ``registry``: cl, start_t, intensity, grade, external (boolean).

    Core events: of grade A (or external, or all, where there are none), of ``threshold`` intensity or more and begun by ``cap``; none left, from the ``fallback`` quantile on.
    The first of ``tracks`` that has a cohort and covers a fitting share of the panel's clusters is taken. Two aggregates of conditional counts decide.
    """
    outside, grade_a = F.coalesce(F.col("external"), F.lit(False)), F.coalesce(F.col("grade") == "A", F.lit(False))
    some = registry.agg(F.max(grade_a).alias("a"), F.max(outside).alias("e"), *[F.percentile(F.when(c, F.col("intensity")), fallback).alias(n) for n, c in (("qa", grade_a), ("qe", outside), ("qall", F.lit(True)))],
                        *[F.max(c & (F.col("intensity") >= threshold) & (F.col("start_t") <= cap)).alias(n) for n, c in (("ca", grade_a), ("ce", outside), ("call", F.lit(True)))]).first()
    base, has, cut = (grade_a, some.ca, some.qa) if some.a else (outside, some.ce, some.qe) if some.e else (F.lit(True), some["call"], some.qall)
    least = threshold if has or cut is None else cut
    core = base & (F.col("intensity") >= F.lit(least)) & (F.col("start_t") <= cap)
    kinds = {"core": core, "external": outside, "all": F.lit(True)}
    first = registry.groupBy("cl").agg(*[F.min(F.when(c, F.col("start_t"))).alias(k) for k, c in kinds.items()])
    clusters = panel.select("cl").distinct().withColumn("_in", F.lit(1))
    met = clusters.join(first, "cl", "full").agg(F.sum("_in").alias("n"), *[F.count(k).alias(f"any_{k}") for k in kinds], *[F.count(F.when(F.col("_in") == 1, F.col(k))).alias(f"in_{k}") for k in kinds]).first()
    share = {k: met[f"in_{k}"] / max(met.n or 0, 1) for k in kinds}
    picks = [(name, kind) for name, kind, low, high in tracks if met[f"any_{kind}"] and low <= share[kind] <= high]
    name, kind = picks[0] if picks else ("all_sources_fallback", "all")
    return first.filter(F.col(kind).isNotNull()).select("cl", F.col(kind).alias("cohort"), F.lit(name).alias("track"))
