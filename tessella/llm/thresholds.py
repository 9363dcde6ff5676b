"""Risk-controlled quality rules: cutoffs with exact binomial bounds on false rejection (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
#: score name: expression over the base measures; larger is worse.
SCORES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_words, 1)",
}
_PLACES = 1 << 20


def _repeated(words: str, n: str) -> str:
    """SQL for the words in windows of three that occur twice or more.

    Each window's hash gives way in its lowest 20 bits to the window's place; after
    sorting these longs, equal neighbours name the few windows that may repeat, and
    those alone are compared as text. Texts of 2**20 words and more compare all.
    """
    composite = f"sort_array(transform(sequence(0, {n} - 3), i -> (xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & {-_PLACES}L) | i))"
    return f"CASE WHEN {n} < 3 THEN array() WHEN {n} >= {_PLACES} THEN transform(sequence(0, {n} - 3), i -> CAST(i AS BIGINT)) ELSE {composite} END"


def base_measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.

    A null text counts as empty: all measures 0, base_failed true.
    """
    m = docs.select(*keep, text_of().alias("_t"))
    m = m.select(
        *keep,
        words_of(F.col("_t")).alias("_w"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    m = m.select(*keep, "_w", F.size("_w").alias("_n"), "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    m = m.withColumn("_c", F.expr(_repeated("_w", "_n")))
    near = f"""CASE WHEN size(_c) = 0 OR _n >= {_PLACES} THEN _c ELSE transform(filter(_c, (x, j) ->
        (j > 0 AND shiftright(x, 20) = shiftright(_c[greatest(j - 1, 0)], 20)) OR (j < size(_c) - 1 AND shiftright(x, 20) = shiftright(_c[least(j + 1, size(_c) - 1)], 20))), x -> x & {_PLACES - 1}L) END"""
    m = m.withColumn("_p", F.expr(near))
    m = m.withColumn("_s", F.expr("CASE WHEN size(_p) = 0 THEN NULL ELSE array_sort(transform(_p, p -> struct(concat_ws(' ', _w[int(p)], _w[int(p) + 1], _w[int(p) + 2]) AS s, int(p) AS p))) END"))
    twice = """sort_array(transform(filter(_s, (x, j) ->
        (j > 0 AND x.s = _s[greatest(j - 1, 0)].s) OR (j < size(_s) - 1 AND x.s = _s[least(j + 1, size(_s) - 1)].s)), x -> x.p))"""
    covered = f"CASE WHEN _s IS NULL THEN 0L ELSE aggregate({twice}, struct(0L AS n, -9 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n) END"
    m = m.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))
    return m.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; about 1e-13 for x of 1 and more."""
    y = x + 8
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + i)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return series - F.log(product)


def allowed_rejections(counts: DataFrame, risk: float, error: float) -> DataFrame:
    """``counts`` (stratum, n, tests) with ``allowed``: the most false rejections k with P(Binomial(n, risk) <= k) <= error / tests; null if even 0 is too many.

    That is the exact (Clopper-Pearson) statement that, at k, the true rate is at
    most ``risk`` with confidence 1 - error / tests.
    """
    tests = counts.select("stratum", "n", (F.lit(error) / F.col("tests")).alias("error"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    term = tests.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") * risk).cast("long"))).alias("k"))
    log_p = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(risk)) + (n - k) * F.log1p(F.lit(-risk))
    up_to = Window.partitionBy("stratum").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = term.withColumn("cdf", F.sum(F.exp(log_p)).over(up_to))
    return summed.groupBy("stratum", "n").agg(F.max(F.when(F.col("cdf") <= F.col("error"), F.col("k"))).alias("allowed"))


def select_cutoffs(holdout: DataFrame, scores: tuple[str, ...], risk: float = 0.015, error: float = 0.05) -> DataFrame:
    """One row for each stratum and score: stratum, score, n (good documents), allowed, cutoff (null: the rule is off).

    ``holdout`` holds labelled good documents: stratum and the scores. Each stratum's
    ``risk`` is shared evenly by the scores; ``error`` is Bonferroni-corrected over
    all (stratum, score) tests. Along one score, cutoffs are tried from lenient to
    strict until the bound fails, a fixed sequence that needs no more correction:
    the last to pass is the (allowed + 1)-th largest good score. Documents above it are rejected.
    """
    each, tests = risk / len(scores), F.count("*").over(Window.partitionBy())
    stacked = holdout.select("stratum", F.expr(f"stack({len(scores)}, {', '.join(f'{s!r}, {s}' for s in scores)}) AS (score, value)"))
    counts = stacked.groupBy(F.struct(F.coalesce("stratum", F.lit("")).alias("stratum"), F.col("stratum").isNull().alias("none"), "score").alias("stratum")).agg(F.count("*").alias("n")).withColumn("tests", tests)
    allowed = allowed_rejections(counts, each, error)
    histogram = stacked.groupBy("stratum", "score", "value").agg(F.count("*").alias("m"))
    down = Window.partitionBy("stratum", "score").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("down", F.sum("m").over(down))
    a = allowed.select(F.col("stratum.stratum").alias("s"), F.col("stratum.none").alias("none"), F.col("stratum.score").alias("c"), "n", "allowed")
    met = ranked.join(a, (F.coalesce("stratum", F.lit("")) == F.col("s")) & (F.col("stratum").isNull() == F.col("none")) & (F.col("score") == F.col("c")))
    return met.groupBy("stratum", "score", "n", "allowed").agg(F.max(F.when(F.col("down") >= F.col("allowed") + 1, F.col("value"))).alias("cutoff"))


def rule_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.015, error: float = 0.05) -> DataFrame:
    """doc_id, the base measures, base_failed, the scores, kept.

    Cutoffs come from labelled good documents (quality 1, not toxic) that pass the
    base rules, by ``select_cutoffs`` in each ``stratum`` (null is one). A rule whose
    stratum has too few labels for the bound is off there. kept is false if
    base_failed, or if a score is above its cutoff. Labels without a quality or
    toxic value don't count; a document labelled twice counts once, as good only if all its labels are. Repeated
    rows each get their own row, and count as often among the labelled. An empty table gives no rows. Other columns are not read.
    """
    work = WorkFolder(docs.sparkSession, "thresholds")
    scores = tuple(SCORES)
    measured = base_measures(docs.select("doc_id", "text", F.col(stratum).alias("stratum")), ("doc_id", "stratum"))
    measured = work.cut(measured.select("*", *[F.expr(e).alias(s) for s, e in SCORES.items()]), "measures")
    whole = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL")
    good = whole.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).filter("good").select("doc_id")
    cutoffs = work.cut(select_cutoffs(measured.filter("NOT base_failed").join(good, "doc_id", "left_semi"), scores, risk, error), "cutoffs")
    wide = cutoffs.groupBy(F.coalesce("stratum", F.lit("")).alias("s"), F.col("stratum").isNull().alias("none")).agg(*[F.max(F.when(F.col("score") == s, F.col("cutoff"))).alias(f"max_{s}") for s in scores])
    out = measured.join(wide, (F.coalesce("stratum", F.lit("")) == F.col("s")) & (F.col("stratum").isNull() == F.col("none")), "left")
    above = F.lit(False)
    for s in scores:
        above = above | F.coalesce(F.col(s) > F.col(f"max_{s}"), F.lit(False))
    return out.select(*measured.drop("stratum").columns, (~F.col("base_failed") & ~above).alias("kept"))


#: The query's rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, lang AS stratum, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
win2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM win),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM win2, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, stratum, CAST(len(w.w) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_dup_lines / greatest(n_words, 1) AS dup_line_ratio FROM m),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) = 1),
h AS (SELECT f.* FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
st AS (SELECT stratum, 'symbol_ratio' AS score, symbol_ratio AS v FROM h UNION ALL SELECT stratum, 'repeat_ratio', repeat_ratio FROM h UNION ALL SELECT stratum, 'dup_line_ratio', dup_line_ratio FROM h),
n AS (SELECT stratum, score, count(*) AS n, count(*) OVER () AS tests FROM st GROUP BY ALL),
k AS (SELECT *, unnest(range(0, CAST(floor(n * 0.005) AS BIGINT) + 1)) AS k FROM n),
cdf AS (SELECT *, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.005) + (n - k) * ln(0.995))) OVER (PARTITION BY stratum, score ORDER BY k) AS c FROM k),
a AS (SELECT stratum, score, max(k) AS allowed FROM cdf WHERE c <= 0.05 / tests GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum, score ORDER BY v DESC) AS down FROM st),
cut AS (SELECT ranked.stratum, ranked.score, max(v) AS cutoff FROM ranked JOIN a ON a.score = ranked.score AND a.stratum IS NOT DISTINCT FROM ranked.stratum WHERE down >= allowed + 1 GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbol_ratio, repeat_ratio, dup_line_ratio,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.stratum IS NOT DISTINCT FROM f.stratum
     AND CASE score WHEN 'symbol_ratio' THEN symbol_ratio WHEN 'repeat_ratio' THEN repeat_ratio ELSE dup_line_ratio END > cutoff) AS kept
FROM f
"""
