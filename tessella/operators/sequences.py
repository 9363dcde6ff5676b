"""State sequences: transitions, spells, hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.functions.columns import sums_before


def own_order() -> WindowSpec:
    """Each unit's rows by period."""
    return Window.partitionBy("unit").orderBy("t")


def five_states(scores: DataFrame, up: str, down: str) -> DataFrame:
    """State by the period's 35 and 65 % quantiles of two scores: surge, stall, volatile (both high), calm (both low), mixed."""
    w = Window.partitionBy("t")
    hi = lambda c: F.col(c) >= F.percentile(c, 0.65).over(w)
    lo = lambda c: F.col(c) <= F.percentile(c, 0.35).over(w)
    state = F.when(hi(up) & hi(down), "volatile").when(hi(up), "surge").when(hi(down), "stall").when(lo(up) & lo(down), "calm").otherwise("mixed")
    return scores.select("*", F.when(F.col(up).isNotNull() & F.col(down).isNotNull(), state).alias("state"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return middle - half, middle + half


def transition_tensor(states: DataFrame) -> DataFrame:
    """Counts, shares and 95 % Wilson bounds of transitions between consecutive periods, for all (grp null) and each group."""
    nxt = states.select("grp", F.col("state").alias("from_state"), F.when(F.lead("t").over(own_order()) == F.col("t") + 1, F.lead("state").over(own_order())).alias("to_state")).filter("from_state IS NOT NULL AND to_state IS NOT NULL")
    counts = nxt.groupingSets([("from_state", "to_state"), ("grp", "from_state", "to_state")], "grp", "from_state", "to_state").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("grp", "from_state"))
    low, high = wilson(F.col("n"), F.col("total"))
    return counts.withColumn("total", total).select("*", (F.col("n") / F.col("total")).alias("share"), low.alias("low"), high.alias("high"))


def transition_matrix(states: DataFrame) -> DataFrame:
    nxt = states.select(F.col("state").alias("from_state"), F.lead("state").over(own_order()).alias("to_state")).filter("from_state IS NOT NULL AND to_state IS NOT NULL")
    counts = nxt.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))).alias("share"))


def spells(states: DataFrame, state: str) -> DataFrame:
    """Maximal runs of consecutive periods in a state: start, end, duration, and whether the exit is seen (a row in the period after)."""
    seen = states.select("unit", "t", "state", F.lead("t").over(own_order()).alias("next_t"))
    runs = seen.filter(F.col("state") == state).withColumn("island", F.col("t") - F.row_number().over(own_order()))
    s = runs.groupBy("unit", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max_by("next_t", "t").alias("after"))
    return s.select("unit", "start", "end", (F.col("end") - F.col("start") + 1).alias("duration"), (F.col("after") == F.col("end") + 1).cast("int").alias("left")).fillna({"left": 0})


def spell_hazard(spell: DataFrame) -> DataFrame:
    """By duration: spells at risk, exits, hazard with Wilson bounds, and survival."""
    d = spell.groupBy("duration").agg(F.count("*").alias("ends"), F.sum("left").alias("exits"))
    at_risk = F.sum("ends").over(Window.orderBy(F.col("duration").desc()).rowsBetween(Window.unboundedPreceding, 0))
    h = d.withColumn("at_risk", at_risk)
    low, high = wilson(F.col("exits"), F.col("at_risk"))
    h = h.select("duration", "at_risk", "exits", (F.col("exits") / F.col("at_risk")).alias("hazard"), low.alias("low"), high.alias("high"))
    upto = Window.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    survival = F.when(F.max((F.col("hazard") >= 1).cast("int")).over(upto) == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("hazard") < 1, 1 - F.col("hazard")))).over(upto)))
    return h.select("*", survival.alias("survival"))


def resilience(bad: DataFrame, good: DataFrame, groups: DataFrame, span: float = 4.0) -> DataFrame:
    """Per group and over all (grp null): of the spells of the bad and of the good state (``spells``) their number, mean duration, half life (least duration at whose end half or fewer
    survive) and survival at the longest one; good half life less bad; a score of 0 to 100, half for a short bad half life and half for a long good one, up to ``span`` periods (0 for one without); dense rank."""
    out = None
    for name, some in (("bad", bad), ("good", good)):
        each = some.join(groups, "unit").select("grp", "duration", "left").union(some.select(F.lit(None).cast(groups.schema["grp"].dataType).alias("grp"), "duration", "left"))
        d = each.groupBy("grp", "duration").agg(F.count("*").alias("ends"), F.sum("left").alias("exits"), F.sum("duration").alias("total"))
        w = Window.partitionBy("grp")  # a row for each duration
        d = d.withColumn("h", F.col("exits") / F.sum("ends").over(w.orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)))
        upto = w.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
        alive = F.when(F.max((F.col("h") >= 1).cast("int")).over(upto) == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("h") < 1, 1 - F.col("h")))).over(upto)))
        d = d.withColumn("alive", alive)
        half = F.min(F.when(F.round("alive", 9) <= 0.5, F.col("duration")))
        g = d.groupBy(F.coalesce("grp", F.lit("")).alias("_k")).agg(F.sum("ends").alias(f"{name}_spells"), (F.sum("total") / F.sum("ends")).alias(f"{name}_mean"), half.alias(f"{name}_half_life"), F.max_by("alive", "duration").alias(f"{name}_survival"))
        out = g if out is None else out.join(g, "_k", "full")
    part = lambda x: F.coalesce(0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), F.lit(0.0))
    score = 100 * (part((span - F.col("bad_half_life")) / span) + part(F.col("good_half_life") / span))
    out = out.select(F.nullif("_k", F.lit("")).alias("grp"), *[F.coalesce(f"{n}_spells", F.lit(0)).alias(f"{n}_spells") for n in ("bad", "good")], *[f"{n}_{c}" for n in ("bad", "good") for c in ("mean", "half_life", "survival")], (F.col("good_half_life") - F.col("bad_half_life")).alias("gap"), score.alias("score"))
    return out.withColumn("rank", F.dense_rank().over(Window.orderBy(F.round("score", 9).desc())))  # a row a group


def half_life(spell: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: spells, mean duration, the least duration that half of them don't outlast, and a dense rank by it."""
    g = spell.join(groups, "unit").groupBy("grp").agg(F.count("*").alias("spells"), F.avg("duration").alias("mean_duration"), F.percentile("duration", 0.5).alias("median"))
    g = g.withColumn("half_life", F.ceil("median").cast("int"))
    return g.select("grp", "spells", "mean_duration", "half_life", F.dense_rank().over(Window.orderBy("half_life")).alias("rank"))


def warned(panel: DataFrame, score: str, event: str, horizons: tuple[int, ...]) -> DataFrame:
    """(horizon, score, hit) of each row and horizon: hit is 1 if an event is among the unit's next rows up to the horizon; rows whose horizon isn't over are left out."""
    long = None
    for h in horizons:
        hit = F.greatest(*[F.lead(event, k).over(own_order()) for k in range(1, h + 1)], F.lit(None).cast("int")) if h > 1 else F.lead(event, 1).over(own_order())
        rows = panel.select(F.lit(h).alias("horizon"), F.col(score).alias("score"), F.when(F.lead(event, h).over(own_order()).isNotNull(), hit).alias("hit")).filter("score IS NOT NULL AND hit IS NOT NULL")
        long = rows if long is None else long.union(rows)
    return long


def warning_horizon(panel: DataFrame, score: str, event: str, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each horizon: rows, base rate of an event within it, and the exact AUC of the score (ties half)."""
    by = warned(panel, score, event, horizons).groupBy("horizon", "score").agg(F.sum("hit").alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    by = sums_before(by, F.col("score"), ["neg"], ("horizon",))
    return by.groupBy("horizon").agg(F.sum("n").alias("rows"), (F.sum("pos") / F.sum("n")).alias("base_rate"), (F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def warning_scores(panel: DataFrame, score: str, event: str, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each horizon: average precision over distinct scores, the Brier score of the score as a probability (clipped to 0..1), and the lift of rows from its 90 % quantile on."""
    long = warned(panel, score, event, horizons)
    by = long.groupBy("horizon", "score").agg(F.sum("hit").alias("pos"), F.count("*").alias("n"))
    by = sums_before(by, -F.col("score"), ["pos", "n"], ("horizon",))
    ap = by.groupBy("horizon").agg((F.sum(F.col("pos") * (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))) / F.sum("pos")).alias("average_precision"))
    cut = long.groupBy("horizon").agg(F.percentile("score", 0.9).alias("cut"))
    g = long.join(cut, "horizon").groupBy("horizon").agg(F.avg(F.pow(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) - F.col("hit"), 2)).alias("brier"), (F.avg(F.when(F.col("score") >= F.col("cut"), F.col("hit"))) / F.avg("hit")).alias("top_lift"))
    return ap.join(g, "horizon")


def regime_forecast(states: DataFrame, horizons: int = 3, smooth: float = 1.0) -> DataFrame:
    """h-step chances from each state to each: powers of the add-``smooth`` transition matrix as joins of its edges."""
    names = states.select("state").filter("state IS NOT NULL").distinct()
    pairs = names.select(F.col("state").alias("from_state")).join(names.select(F.col("state").alias("to_state")), F.lit(True))  # a handful of states
    p = pairs.join(transition_matrix(states), ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(smooth))
    one = p.select("from_state", "to_state", (F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))).alias("p"))
    step, out = one, one.withColumn("h", F.lit(1))
    for h in range(2, horizons + 1):
        nxt = one.select(F.col("from_state").alias("mid"), F.col("to_state").alias("end"), F.col("p").alias("q"))
        step = step.join(nxt, F.col("to_state") == F.col("mid")).groupBy("from_state", F.col("end").alias("to_state")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        out = out.union(step.withColumn("h", F.lit(h)))
    return out
