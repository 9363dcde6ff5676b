"""Long runs that begin like a secret, vectors of very different lengths, tables that only look like the index's."""

import random
import time

import numpy as np
import pytest

from tessella.llm import fingerprints, neighbours, secrets


def plain_nearest(base, ids, q, own, k):
    with np.errstate(over="ignore"):
        d = np.sqrt(((base - q) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return ids[order].tolist(), d[order].tolist()


@pytest.mark.parametrize("scale", [(1.0, 1.0), (1e-2, 1e5), (1e200, 1.0), (1.0, 1e200), (1e300, 1e300), (1e-160, 1e-160)])
def test_nearest_of_any_scale(scale):
    rng = np.random.default_rng(9)
    for _ in range(30):
        base = rng.normal(size=(60, 8)) * scale[0]
        base[10:20] = base[:10]  # copies
        base[30:34] *= 1e3
        q = np.concatenate([rng.normal(size=(5, 8)) * scale[1], base[:5]])
        ids = rng.permutation(1000)[:60]
        own = np.concatenate([np.full(5, -1), ids[:5]])
        for (found, d), x, o in zip(neighbours.nearest(base, ids, q, own, 10), q, own, strict=True):
            assert (found.tolist(), d.tolist()) == plain_nearest(base, ids, x, o, 10)


def test_long_runs_like_a_token_take_linear_time(spark):
    def seconds(size):
        texts = [("eyJ" * (size // 3), "eyJ-" * (size // 4), "eyJabcdefgh." * (size // 12) + "!")]
        began = time.time()
        rows = secrets.find_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts[0])], "doc_id long, text string")).collect()
        return time.time() - began, rows

    seconds(1000)
    took, rows = seconds(1_000_000)
    assert took < 60 and [r.spans == "" for r in sorted(rows)][:2] == [True, True]


def test_tokens_among_runs_that_fail(spark):
    good = "eyJabcdefgh12.abcdefgh34.sig_na-ture"
    texts = [good, "x" + good + "y", "eyJ " + good, "eyJ." + good, "eyJshort.ab.c " + good, "eyJabcdefgh.eyJabcdefgh.x", "eyJabcdefgh", "é" + good]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: r.spans for r in rows}
    for i, text in enumerate(texts[:5]):
        assert f"jwt:{text.index(good)}:" in spans[i], (i, spans[i])
    assert "jwt:0:25" in spans[5] and "jwt" not in spans[6] and "jwt:1:" in spans[7]


def test_an_index_drops_no_table_of_others(spark, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("none", path=str(tmp_path / "none"))
    rng, path = random.Random(3), f"file://{tmp_path}/index"
    for batch in range(5):  # each time opened anew: what it merges and drops has no name in this session
        docs = spark.createDataFrame([(10 * batch + i, " ".join(rng.choices("abcdefgh", k=60))) for i in range(4)], "doc_id long, text string")
        fingerprints.FingerprintIndex(spark, path, 2, fanout=2).add(docs)
    assert spark.table("none").count() == 3
    spark.sql("DROP TABLE none")
