"""Exact top-k and url rules against brute force."""
import math

import numpy as np
import pytest

from paylake.llm import topk as T


def brute(rows, step, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in rows:
        if i is not None and i % step == 0 and v and all(x is not None and math.isfinite(x) for x in v):
            first[i] = min(first.get(i, v), v)
    out = []
    for q, v in first.items():
        a = [math.floor(1024 * x) for x in v]
        got = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(80)]                        # ties
    rows += [(20, rows[20][1]), (20, [0.5] * 8), (None, [1.0] * 8), (40, None), (2000, []), (2020, [1.0, None]),
             (2040, [math.nan] * 8), (2060, [math.inf] * 8), (2080, [1.0, 2.0]), (2081, [3.0, 4.0]), (3000, [0.0] * 8), (-20, [2.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(5)
    got = sorted(tuple(r) for r in T.search(df, step=20, k=5).collect())
    assert got == brute(rows, 20, 5)


def test_large_numbers_and_empty(spark):
    rows = [(i, [float(10**12 + i * 7), -float(10**12 - i), 3.5]) for i in range(40)] + [(50, [1e300, -1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in T.search(df, step=10, k=4).collect()) == brute(rows, 10, 4)
    assert T.search(df.filter("false")).collect() == []
