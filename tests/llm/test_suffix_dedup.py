"""Repeated passages against listing every 400-byte string."""
import numpy as np
from hypothesis import given, settings, strategies as st

from paylake.llm import suffix_dedup as S


def run(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, lo int").repartition(5)
    import hashlib
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
                  for r in S.removed(df).collect())


def want(texts, ids=None):
    got = S.brute_force([(t or "").encode() for t in texts])
    ids = ids or list(range(len(texts)))
    return sorted((i is not None, i or 0, *g) for i, g in zip(ids, got))


def corpus(rng):
    word = lambda: "".join(rng.choice(list("abcdefghéß"), int(rng.integers(1, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c = text(120), text(200), text(90)
    d = text(150)
    return [None, "", "short", "a" * 1200, "ab" * 900, a, a, text(20) + b + text(30), text(10) + b, b[30:] + c, c + b[:700],
            c, d + "X" + d, text(300), (text(70) + "\n") * 4, b[:399], b[100:500], "Z" * 399, "Q" * 400, "W" * 401,
            " ".join([a, b, c, d]), a[:500] + "!" + a[501:], a[:300] + "#" + a[301:]]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(np.random.default_rng(seed))
        assert run(spark, texts) == want(texts)


def test_repeated_ids_rows_and_empty_table(spark):
    t = "".join(chr(97 + i * i * 7 % 26) for i in range(900))
    u = "".join(chr(97 + (i * i * 11 + i) % 25) for i in range(900))
    texts, ids = [t, t, u, "v" + u[450:], None, None], [1, 1, 1, None, None, 7]
    assert run(spark, texts, ids) == want(texts, ids)
    assert run(spark, []) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 700), st.integers(1, 900)), min_size=1, max_size=6), st.integers(0, 50))
def test_every_start_has_a_row(parts, seed):
    """parse() covers each start position of a 400-byte string, and no other."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(97, 100 + k * 4, 2000).astype(np.uint8) for k in range(6)]
    base[0][:] = 97
    texts = [base[k][a:a + n] for k, a, n in parts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = S.parse(np.concatenate(texts), off)
    for d, t in enumerate(texts):
        got = [i for x, a, b in zip(rows["doc"], rows["lo"], rows["hi"]) if x == d for i in range(a, b + 1)]
        assert set(got) == set(range(max(0, len(t) - S.LENGTH + 1)))
