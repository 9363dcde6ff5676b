"""Mixing sources to target weights by exponential-key sampling (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, boxed, in_row, n_words_of, text_of, unboxed, unit_draw

def shape_weight(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: 1 for six characters a word with its gap, less the further from it; 0.1 without words."""
    return F.when(size > 0, 1 / (1 + F.abs(F.length(text) / size - 6) / 6)).otherwise(0.1)


def source_targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, n_docs, target.

    Sources in code point order, null last, weigh ``weights`` over and over.
    ``share`` times all sizes is dealt by weight, none above ``most`` times its
    own size, what is above going to the others by weight. That fixpoint is
    min(cap, level * weight) for one level, found by sorting cap / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = per.select("*", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.select(
        "*",
        ((F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("level"),
        F.row_number().over(rising).alias("at"),
    )
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))).over(everything)
    return levels.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(first["level"], F.lit(0.0)) * F.col("w")).alias("target"))


def draw_key(doc_id: Column, text: Column, size: Column, seed: int = 17, weight=shape_weight) -> Column:
    """An exponential draw by id and text, over the quality weight: the smallest keys are an Efraimidis-Spirakis sample."""
    return -F.log(unit_draw(seed, doc_id, text)) / weight(text, size)


def running_sums(rows: DataFrame, group: str, value: str, place: str) -> DataFrame:
    """``rows`` of a written table with ``upto``, the sum of ``value`` in the row's group up to the row, in ``place`` order.

    ``place`` is the file's number in the upper bits and the row's in the lower 33. Sums within each file
    come on top of the files' own running sums, so a group of any size is dealt over as many tasks as files.
    """
    filed = rows.withColumn("file", F.shiftright(F.col(place), 33))
    earlier = Window.partitionBy(group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sums = filed.groupBy(group, "file").agg(F.sum(value).alias("file_sum"))
    sums = sums.select(F.col(group).alias("g"), F.col("file").alias("f"), F.coalesce(F.sum("file_sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(group, "file").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    met = filed.withColumn("inside", F.sum(value).over(within)).join(sums, F.col(group).eqNullSafe(F.col("g")) & (F.col("file") == F.col("f")))
    return met.withColumn("upto", F.col("offset") + F.col("inside")).drop("file", "inside", "g", "f", "offset")


def plan_mix(docs: DataFrame, work: WorkFolder, seed: int = 17, weight=shape_weight, **shares) -> DataFrame:
    """One row for each of ``docs`` (doc_id, source, text): doc_id, source, size, key, source_size, target, epochs, again.

    Every document of a source is taken ``epochs`` whole times; then those that are ``again`` once more: in
    the order of their keys, from the smallest, as long as the running sum of sizes, with half the document's own, is within
    the rest of the target. Rows of equal key (equal id and text) follow one another
    in any order, and the cut may fall between them. The order is made by ranges of (source, key), whose edges Spark samples from
    the keys themselves, so that whatever the weights, sources and copies, the ranges are about even.
    """
    texts = docs.select("doc_id", "source", n_words_of(text_of()).alias("size"), text_of().alias("t"))
    sized = work.cut(texts.select("doc_id", "source", "size", draw_key(F.col("doc_id"), F.col("t"), F.col("size"), seed, weight).alias("key")), "sizes")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = work.cut(source_targets(sized, **shares).select(F.col("source").alias("s"), "source_size", "target", epochs.alias("epochs")), "targets")
    # the number tells rows apart that are equal in all else, so that they can part
    order = [F.col("source").asc_nulls_last(), "key", "doc_id", "size", "number"]
    ranged = sized.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = work.cut(ranged.select("doc_id", "source", "size", "key", F.monotonically_increasing_id().alias("place")), "ordered")
    met = running_sums(ordered, "source", "size", "place").join(per, F.col("source").eqNullSafe(F.col("s")))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return met.select("doc_id", "source", "size", "key", "source_size", "target", "epochs", ((rest > 0) & (F.col("upto") - F.col("size") / 2 <= rest)).alias("again"))


def mix_sources(docs: DataFrame, seed: int = 17, weight=shape_weight, **shares) -> DataFrame:
    """The mix of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken (words taken, repeats counted), copies.

    A null text has size 0, a null source is a source of its own, null ids draw by their text. Rows of equal id and text
    share a draw; where the budget ends among them some are taken and some not, so a source's
    taken words are within half a document of its target. A document longer than what is left of the target may miss.
    An empty table gives no rows; sources without words take nothing. Other columns are not read.
    """
    plan = plan_mix(docs.select("doc_id", "source", "text"), WorkFolder(docs.sparkSession, "mix"), seed, weight, **shares)
    copies = F.col("epochs") + F.col("again").cast("long")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def remix(docs: DataFrame, seed: int = 17, weight=shape_weight, **shares) -> DataFrame:
    """The documents themselves, each as often as the mix (``mix_sources``) takes it; columns, whatever their names, as given.

    Documents find their copies by key again. Rows that share the last key of their source (equal id and text) are numbered, file by file, and as many
    of them as the mix takes are taken again.
    """
    work = WorkFolder(docs.sparkSession, "mix")
    plan = work.cut(plan_mix(docs.select("doc_id", "source", "text"), work, seed, weight, **shares), "plan")
    last = plan.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("again"), F.col("key"))).alias("last_key"))
    ties = plan.filter("again").groupBy("source", "key").agg(F.count("*").alias("ties"))
    last = last.join(ties.select(F.col("source").alias("t"), F.col("key").alias("k"), "ties"), F.col("source").eqNullSafe(F.col("t")) & (F.col("last_key") == F.col("k")), "left")
    last = work.cut(last.select(F.col("source").alias("s"), "epochs", "last_key", F.coalesce("ties", F.lit(0)).alias("ties")), "last")
    text = text_of(in_row("text"))
    sized = boxed(docs).withColumn("size", n_words_of(text)).withColumn("key", draw_key(in_row("doc_id"), text, F.col("size"), seed, weight))
    met = sized.join(last, in_row("source").eqNullSafe(F.col("s")))
    tied = F.coalesce(F.col("key") == F.col("last_key"), F.lit(False))
    sure = met.filter(~tied).select("row", (F.col("epochs") + F.coalesce((F.col("key") < F.col("last_key")).cast("long"), F.lit(0))).alias("copies"))
    numbered = work.cut(met.filter(tied).select("row", "s", "epochs", "ties", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("place")), "tied")
    edge = running_sums(numbered, "s", "one", "place").select("row", (F.col("epochs") + (F.col("upto") <= F.col("ties")).cast("long")).alias("copies"))
    out = sure.union(edge).filter("copies > 0")
    return unboxed(out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))


#: The query's rows in DuckDB.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
            / CASE WHEN size > 0 THEN 1 / (1 + abs(length(t) / size - 6) / 6) ELSE 0.1 END AS key FROM sized),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM sized GROUP BY source),
capped AS (
  SELECT *, 2.0 * source_size AS cap, CASE (rn - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM per),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, rn) AS nr FROM capped),
picked AS (SELECT level AS l FROM levels WHERE level <= cap / w ORDER BY nr LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT l FROM picked), 0) * w)::DOUBLE AS target FROM levels),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT k.doc_id, k.size, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source),
taken AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM taken
"""
