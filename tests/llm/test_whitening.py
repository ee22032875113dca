"""Whitening against plain integer and float64 linear algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(vec_id -> [(component, n, deviation, whitened)], eigenvalues) by direct sums."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, d = len(distinct), len(distinct[0])
    s = [sum(x[k] for x in distinct) for k in range(d)]
    cov = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in distinct) / n ** 3 for j in range(d)]
                    for i in range(d)])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:4]
    out = []
    for i, x in good:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        w = (np.array(x) - np.array(s) / n) @ v[:, order] / np.sqrt(e[order])
        out += [(i, k + 1, n, dev, w[k], e[o] / np.trace(cov)) for k, o in enumerate(order)]
    return out


def check(got, want):
    got = sorted(got, key=lambda r: (r["vec_id"], r["deviation"], r["component"]))
    want = sorted(want, key=lambda r: (r[0], r[3], r[1]))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [r[:4] for r in want]
    for comp in range(1, 5):
        a = np.array([r["whitened"] for r in got if r["component"] == comp])
        b = np.array([r[4] for r in want if r[1] == comp])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
    assert np.allclose([r["explained"] for r in got], [r[5] for r in want])
    assert max(r["identity_error"] for r in got) < 1e-9


def test_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 7)) * np.array([3, 2, 1.5, 1, .5, .3, .2])
    rows = [(i, [float(c) for c in base[i % 250]]) for i in range(300)]          # 50 repeated vectors
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 5), (1002, [float("nan")] * 7), (1003, [float("-inf")] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), plain(rows))


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = whitening.op11_whitening(spark, sf_dir).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(got, plain(rows))


@pytest.mark.parametrize("high", [1, 2, 5, 1000, 2 ** 40, 2 ** 63 - 1])
def test_scatter_is_exact(high):
    rng = np.random.default_rng(high % 97)
    x = rng.integers(-high, high, size=(130, 5), endpoint=True).astype(np.int64)
    x[:, 3] = 17                                                                 # no spread: no planes
    ones = np.concatenate([x, np.ones((130, 1), np.int64)], axis=1).astype(object)
    assert (whitening.scatter(x) == ones.T @ ones).all()


def test_blocks_add_up(spark):
    rows = [(i, [float(i % 11), float(i * i % 7), float(i)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    check(whitening.whiten(df, block_values=40).collect(), plain(rows))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    none = spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)
    assert whitening.whiten(none).count() == 0
    # one vector alone, repeated, null id: no spread
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0), (5, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in one) == [(0, 1), (0, 2), (5, 1), (5, 2)]
    assert all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None
               and r["identity_error"] is None for r in one)
    # entries beyond the long range, and negative zero
    wide = whitening.whiten(spark.createDataFrame([(1, [3e38, -0.0], 0), (2, [-3e38, 0.0], 0)], SCHEMA)).collect()
    assert len(wide) == 4 and {r["deviation"] for r in wide} == {None}
    assert {int(r["deviation_text"]) for r in wide} == {(2 ** 64 - 1) ** 2}


def test_lengths_apart_and_passes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    a = [(i, [float(i), float(i % 3)]) for i in range(20)]
    b = [(100 + i, [float(i % 5), float(i), float(i * i % 13)]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in a + b], SCHEMA)
    df = df.withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("d", F.lit("clash"))
    got = whitening.whiten(df).collect()
    for rows in (a, b):
        ids = {i for i, _ in rows}
        part = [r for r in got if r["vec_id"] in ids]
        want = plain(rows)
        assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in part) == sorted(w[:4] for w in want)
