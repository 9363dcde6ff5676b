"""How far the sources of a language are apart in their use of words, over run-length columns of counts."""

from __future__ import annotations

from collections import Counter
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder

#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Distinct terms that a task counts before it sends them on.
HELD = 400_000
#: Groups that a task compares at a time; more are compared block by block.
BLOCK = 1024
#: Terms by group in part ``term``.
TOP = 10

#: Bytes of terms, A-Z as a-z; all others as spaces. Bytes from 128 on are parts of characters beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counts(batches):
    """What each task has counted, in parts; besides a row with a null term for each group."""
    import pyarrow as pa

    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in _COUNTS.split(", ")]
    held: dict = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            terms = [None, *(t.decode() for t in n)]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(docs[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from out()
            held = {}
    yield from out()


def share(n: str, size: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / size), exact for longs."""
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({size} as decimal(20,0))"


def shares(n: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / size) by long division, three decimal digits a step, so that nothing leaves 64 bits while size is below 2**53."""
    out, rest = (n + 2) // size, (n + 2) % size
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // size, rest * 1000 % size
    return 1 + out


class RunColumn:
    """One group's shares, run-length encoded over the terms in their order."""

    def __init__(self, counts: np.ndarray, size: int) -> None:
        self.start = np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1]]))
        self.share = shares(counts[self.start], size)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.share[np.searchsorted(self.start, places, side="right") - 1]


def run_divergence(x: RunColumn, y: RunColumn, before: np.ndarray) -> int:
    """The sum of floor((p - q)^2 / (p + q)): the runs' boundaries intersect, and each piece counts as often as it is long.

    ``before[i]`` is the number of terms before place i; the last one is that of all.
    """
    cuts = np.union1d(x.start, y.start)
    p, q = x.at(cuts), y.at(cuts)
    return int((((p - q) ** 2 // (p + q)) * np.diff(before[np.append(cuts, len(before) - 1)])).sum())


def _pair_sums(batches, langs: dict):
    """(a, b, value) over the vectors of this task. langs: by language its groups' numbers, sizes (N + 2 V), and blocks."""
    import pyarrow as pa

    sums: Counter = Counter()
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), len(lang)] if len(lang) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lang[lo] not in langs:
                continue
            numbers, sizes, blocks = langs[lang[lo]]
            part = batch.slice(lo, hi - lo)
            before = np.concatenate([[0], np.cumsum(part.column(2).to_numpy())])
            vector = part.column(1)
            group, n = (vector.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("g", "n"))
            row = np.repeat(np.arange(hi - lo), vector.value_lengths().to_numpy())
            at = np.searchsorted(numbers, group).clip(max=len(numbers) - 1)
            known = numbers[at] == group
            counts = np.zeros((len(numbers), hi - lo), dtype=np.int64)
            counts[at[known], row[known]] = n[known]
            columns = [RunColumn(c, size) for c, size in zip(counts, sizes, strict=True)]
            one, other = [np.flatnonzero(blocks == b) for b in (blocks.min(), blocks.max())]
            for i, j in combinations(one, 2) if len(np.unique(blocks)) == 1 else product(one, other):
                sums[int(numbers[i]), int(numbers[j])] += run_divergence(columns[i], columns[j], before)
    rows = [(a, b, v) for (a, b), v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "value"])


def _pair_blocks(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sums by pair of groups, BLOCK groups against BLOCK groups at a time; so many rows of ``groups`` reach the driver at once."""
    block = F.floor(F.col("g") / BLOCK).alias("block")
    spans = groups.groupBy("lang").agg(F.min(block).alias("lo"), F.max(block).alias("hi"))
    spans = spans.groupBy("lo").agg(F.max("hi").alias("hi")).collect()  # one row a block at most
    jobs = sorted({(a, b) for s in spans for a in range(s.lo, s.hi + 1) for b in range(a, s.hi + 1)})
    out = vectors.sparkSession.createDataFrame([], "a long, b long, value long")
    for a, b in jobs:
        langs: dict = {}
        for r in groups.filter(block.isin(a, b) & (F.col("v") > 0)).orderBy("g").collect():
            langs.setdefault(r.lang, []).append((r.g, r.total + 2 * r.v, r.g // BLOCK))
        langs = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in langs.items()}
        langs = {k: v for k, v in langs.items() if a == b or len(np.unique(v[2])) == 2}
        out = out.union(vectors.mapInArrow(lambda x, langs=langs: _pair_sums(x, langs), "a long, b long, value long"))
    return out.groupBy("a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language, and its most marking terms.

    1. Occurrences and documents by (language, source, term); the terms in LEAST_DOCS documents of their language stay.
    2. Each term's counts over the sources are one vector; terms of equal vectors are counted together, and vectors sorted, so
       that equal counts stand together in every source's column.
    3. A task holds a stretch of vectors: each source's column is run-length encoded, the runs of two sources are intersected,
       and f is multiplied by the run's length. Sums of the stretches are added up.

    Nulls in text, lang and source are empty texts. Each row is a document, repeated ones too. A group without terms has
    pairs (0 each if its language keeps no terms) but no term rows; an empty table gives no rows. Exact while a language has fewer than
    2**53 occurrences of kept terms. The pairs of a language are as many as its sources squared, as the result is.
    """
    work = WorkFolder(docs.sparkSession, "divergence")
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = docs.select(*filled).withColumn("text", F.col("text").cast("binary"))
    sums = [F.sum(c).alias(c) for c in ("n", "docs")]
    counts = work.cut(texts.mapInArrow(_counts, _COUNTS).groupBy("lang", "source", "term").agg(*sums), "counts")

    # smaller groups have fewer different counts: as first columns they make the longest runs
    by_size = Window.orderBy("lang", "all", "source")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    named = work.cut(sizes.select("lang", "source", (F.row_number().over(by_size) - 1).cast("long").alias("g")), "named")
    placed = counts.filter("term IS NOT NULL").join(named, ["lang", "source"])
    vector = F.sort_array(F.collect_list(F.struct("g", "n"))).alias("vector")
    terms = placed.groupBy("lang", "term").agg(vector, F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = work.cut(terms.filter(F.col("docs") >= LEAST_DOCS).drop("docs"), "terms")
    work.drop("counts")

    used = terms.select("lang", "term", "total", F.explode("vector").alias("x")).select("lang", "term", "total", "x.g", "x.n")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    of_group = used.groupBy("g").agg(F.sum("n").alias("total"))
    groups = named.join(of_group, "g", "left").join(of_lang, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = work.cut(groups, "groups")

    vectors = terms.groupBy("lang", "vector").agg(F.count("*").alias("terms"))
    vectors = work.cut(vectors.repartitionByRange("lang", "vector").sortWithinPartitions("lang", "vector"), "vectors")
    half = work.cut(_pair_blocks(groups, vectors), "sums")
    both = half.union(half.select("b", "a", "value"))
    x, y = groups.select("lang", "source", F.col("g").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pairs = x.join(y, "lang").filter("a <> b").join(both, ["a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    sized = used.join(groups.select("g", "source", F.col("total").alias("group_total"), "lang_total", "v"), "g")
    p, q = F.expr(share("n", "group_total + 2 * v")), F.expr(share("total", "lang_total + 2 * v"))
    marking = sized.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    marking = marking.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(marking.select("*", rank).filter(F.col("rank") <= TOP))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM words),
kept AS (SELECT lang, term, count(*) AS total FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM words),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (size + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (total + 2)) // (lang_total + 2 * v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) JOIN sizes USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
