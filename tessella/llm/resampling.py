"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import WorkFolder, boxed, in_row, slices, text_of, unboxed, unit_draw
from tessella.llm.words import mix

N_GRAM = 4
BUCKETS = 1 << 18
#: The labelled documents a model may learn from, and the folds they are dealt into to tell how many documents to take.
MOST_LABELLED, FOLDS = 40_000, 5


def hashed_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams, a space before and after each text, and where each text's begin and end."""
    data = np.frombuffer(b"".join(b" " + t + b"  " for t in texts), dtype=np.uint8).astype(np.uint32)
    key = np.zeros(max(len(data) - N_GRAM + 1, 0), dtype=np.uint32)
    for i in range(N_GRAM):
        key = (key << np.uint32(8)) | data[i : len(key) + i]
    sizes = np.array([len(t) + 3 for t in texts])
    ends = np.cumsum(sizes)
    return (mix(key.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int32), np.stack([ends - sizes, np.maximum(ends - N_GRAM + 1, ends - sizes)], axis=1)


def labelled_sample(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, good, fold (from 0 on) of at most ``most`` labelled documents, by a hash of the id.

    Good: quality 1 and not toxic, by all of the document's labels; rows with a null don't count.
    """
    whole = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    each = whole.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    drawn = each.withColumn("h", F.xxhash64(F.lit(23), "doc_id")).orderBy("h", "doc_id").limit(most)
    return drawn.select("doc_id", "good", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))


def fit_ratios(docs: DataFrame, sample: DataFrame, smooth: float = 0.1) -> np.ndarray:
    """log(target / raw) of each bucket, a row for each fold and one more: add-``smooth`` estimates, target from the sample's good documents outside the fold (the last: all), raw from all of ``docs``.

    Each task sums its documents' counts; the driver gets a few numbers a bucket, however large ``docs`` is. All 0 without good documents.
    """
    good = F.broadcast(sample.filter("good").select(F.col("doc_id").alias("id"), "fold"))
    targets = [f"t{k}" for k in range(FOLDS)]

    def count(batches):
        import pyarrow as pa

        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros((FOLDS, BUCKETS), dtype=np.int64)
        for batch in batches:
            folds = batch.column(1).to_pylist()
            for first, texts in slices(x.as_py() for x in batch.column(0)):
                grams, at = hashed_grams(texts)
                for d, (a, b) in enumerate(at, first):
                    if folds[d] is not None:
                        np.add.at(target[folds[d]], grams[a:b], 1)
                inside = np.ones(len(grams), dtype=bool)
                for a, b in zip(at[:, 1], [*at[1:, 0], len(grams)], strict=True):
                    inside[a:b] = False
                raw += np.bincount(grams[inside], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), *(pa.array(t[seen]) for t in target)], ["bucket", "raw", *targets])

    flagged = docs.join(good, F.col("doc_id") == F.col("id"), "left").select(text_of().cast("binary"), "fold")
    counted = flagged.mapInArrow(count, ", ".join(f"{c} long" for c in ("bucket", "raw", *targets)))
    rows = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", *targets)]).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros((FOLDS, BUCKETS))
    raw[rows.bucket], target[:, rows.bucket] = rows.raw, rows[targets].to_numpy().T
    target = np.vstack([target.sum(0) - target, target.sum(0)])
    log_share = lambda c: np.log((c + smooth) / (c.sum(-1, keepdims=True) + smooth * BUCKETS))
    return (log_share(target) - log_share(raw)) * (target.sum(1, keepdims=True) > 0)


def weigh(docs: DataFrame, ratios: np.ndarray, model: str | None = None, seed: int = 29) -> DataFrame:
    """Boxed ``docs`` (doc_id, text and others) with log_weight and gumbel_key.

    log_weight, the log of p_target(text) / p_raw(text), sums the log ratios of all the text's n-grams, by the row of ``ratios`` that the
    column ``model`` names (None: the last). gumbel_key adds a Gumbel draw by doc_id: the k largest keys are a sample of k documents without
    replacement, by weight. A null text is empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            weights: list[float] = []
            which = batch.column(2).to_pylist()
            for first, texts in slices(x.as_py() for x in batch.column(1)):
                grams, at = hashed_grams(texts)
                weights.extend(float(shared.value[m][grams[a:b]].sum()) for m, (a, b) in zip(which[first:], at, strict=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64())], ["row", "log_weight"])

    rows = boxed(docs)
    schema = T.StructType([rows.schema["row"], T.StructField("log_weight", T.DoubleType())])
    used = in_row(model) if model else F.lit(len(ratios) - 1)
    scored = rows.select("row", text_of(in_row("text")).cast("binary").alias("text"), used.alias("model")).mapInArrow(score, schema)
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit_draw(seed, in_row("doc_id")))))


def target_share(docs: DataFrame, sample: DataFrame, ratios: np.ndarray, loss_ratio: float = 10.0) -> float:
    """The share of documents to take: of the sample in the order of its keys, each by the model that its fold did not train, the share from the top with the least cost, ``loss_ratio`` times the
    good ones lost and the bad ones taken, each as a share of its kind (ties: the smaller).

    1 if there are no good or no bad documents. At most one key for each labelled document reaches the driver.
    """
    met = docs.select("doc_id", "text").join(F.broadcast(sample.select(F.col("doc_id").alias("id"), "good", "fold")), F.col("doc_id") == F.col("id"))
    scored = weigh(met.select("doc_id", "text", "good", "fold"), ratios, "fold").groupBy(in_row("doc_id").alias("doc_id")).agg(F.min(in_row("good")).alias("good"), F.min("gumbel_key").alias("key"))
    rows = scored.select("good", "key").toPandas().sort_values("key", ascending=False)
    good = rows.good.to_numpy(dtype=bool)
    if not good.any() or good.all():
        return 1.0
    cost = loss_ratio * (1 - np.cumsum(good) / good.sum()) + np.cumsum(~good) / (~good).sum()
    return float(np.argmin(np.round(cost, 12)) + 1) / len(good)


def kth_largest(scored: DataFrame, k: int, key: str = "gumbel_key") -> float | None:
    """The k-th largest key, nulls aside (the least one, if fewer); None without rows or k.

    Counts of rows in 4096 ranges, of the fullest resolution where the k-th lies, narrow
    it down round by round; only counts reach the driver.
    """
    low, high, above = *scored.agg(F.min(key), F.max(key)).first(), 0
    if low is None or k <= 0:
        return None
    if scored.filter(F.col(key).isNotNull()).count() <= k:
        return low
    while low < high:
        width = (high - low) / 4096
        if low + width <= low or high - width >= high:
            break
        place = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(4095)).alias("place")
        inside = scored.filter((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        counts = {r.place: (r["count"], r.low, r.high) for r in inside.groupBy(place).agg(F.count("*").alias("count"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for at in sorted(counts, reverse=True):
            if above + counts[at][0] >= k:
                break
            above += counts[at][0]
        n, low, high = counts[at]
        if above + n == k:
            break  # the k-th is the least of this range
    return low


def top_k(scored: DataFrame, k: int, key: str = "gumbel_key") -> DataFrame:
    """The rows of the k largest keys (all rows, if fewer); rows tied with the last are kept too."""
    least = kth_largest(scored, k, key)
    return scored.limit(0) if least is None else scored.filter(F.col(key) >= F.lit(least))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Boxed ``docs`` (doc_id, text and others) with log_weight, gumbel_key and kept: the key is among the k largest.

    k is ``share`` of the number of documents; where none is named, what ``target_share`` reads from labelled documents.
    Keys come from one pass over the texts, and from another with the verdict: no text is shuffled or written.
    Labels with a null don't count. Without labels of both kinds all documents are kept. A null or empty text has its few n-grams'
    weight. Repeated ids share their draw; rows tied with the k-th are all kept. An empty table gives no rows.
    """
    work = WorkFolder(docs.sparkSession, "resampling")
    sample = work.cut(labelled_sample(labels, most_labelled), "sample")
    texts = docs.select("doc_id", "text")
    ratios = fit_ratios(texts, sample)
    share = target_share(texts, sample, ratios) if share is None else share
    if share >= 1:
        return weigh(docs, ratios).withColumn("kept", F.lit(True))
    keys = work.cut(weigh(texts, ratios).select("gumbel_key"), "keys")
    least = kth_largest(keys, int(np.ceil(share * keys.count())))
    return weigh(docs, ratios).withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of every row; see ``resample``."""
    return resample(docs.select("doc_id", "text"), labels, **options).select(in_row("doc_id").alias("doc_id"), "log_weight", "gumbel_key", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, columns as given, whatever their names."""
    return unboxed(resample(docs, labels, **options).filter("kept"))
