"""Passages of over 50 words that other documents have too, against listing every window of 51 words."""
import glob
import os
import time

import numpy as np
from hypothesis import given, settings, strategies as st

from paylake.llm import common
from paylake.llm import suffix_dedup as S
from paylake.llm import word_passages as W


def told(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t) for i, t in enumerate(texts)]
    got = S.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_passage_words) for r in got)


def want(texts, ids=None):
    ids = ids or list(range(len(texts)))
    return sorted((i is not None, i or 0, n) for i, n in zip(ids, W.brute_force([(t or "").encode() for t in texts])))


def corpus(rng):
    word = lambda most: "".join(rng.choice(list("abcdefghéß"), int(rng.integers(1, most))))
    text = lambda n, most=9: " ".join(word(most) for _ in range(n))
    a, b, c, short = text(120), text(300), text(70), text(51, 5)
    edited = b.split()
    edited[150] = "other"
    return [None, "", "  \n", "short", a, a, text(30) + " " + short + " " + text(40), "\n" + short.replace(" ", " \t\n"), text(20) + " " + short,
            short.rsplit(" ", 1)[0] + " x", c + " " + text(9) + " " + c, text(200), b, " ".join(edited), b[300:900], "la " * 400, "la " * 70, "la " * 50,
            " ".join([text(60), c[20:], a]), (text(60) + "\n") * 3, text(80) + " " + a, "x" * 5000]


def test_equals_listing_every_window(spark):
    for seed in (1, 2, 3):
        texts = corpus(np.random.default_rng(seed))
        assert told(spark, texts) == want(texts)


def test_a_passage_below_400_bytes_is_told_and_stays(spark):
    """Contract columns keep to 400 bytes; before, nothing told such a passage."""
    passage = " ".join(f"w{i}" for i in range(60))
    texts = ["one " + passage + " two", "three " + passage, "clean " + " ".join(f"z{i}" for i in range(90)),
             passage.rsplit(" ", 10)[0], (" ".join(f"y{i}" for i in range(60)) + "\n") * 2]
    assert len(passage) < S.LENGTH
    got = {r.doc_id: r for r in S.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_passage_words for i in range(5)] == [60, 60, 0, 0, 0]
    assert all(got[i].n_removed == 0 and got[i].kept.decode() == t for i, t in enumerate(texts[:4]))


def test_repeated_ids_and_rows(spark):
    t = " ".join(f"a{i * i % 97}" for i in range(90))
    u = " ".join(f"b{i}" for i in range(90))
    texts, ids = [t, t, u, "v " + u[60:], None, None], [1, 1, 1, None, None, 7]
    assert told(spark, texts, ids) == want(texts, ids)
    assert told(spark, []) == []


def test_runs_in_one_document_and_in_another(spark):
    """A document's second run of a span that no other document has is resolved too."""
    p = " ".join(f"p{i}" for i in range(60))
    q = " ".join(f"q{i}" for i in range(30))
    texts = [f"{q} {p} {q} m {q} {p} {q}", f"x {p} y", f"{q} {p} z"]
    assert told(spark, texts) == want(texts)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 100), st.integers(0, 200)), min_size=1, max_size=6), st.integers(0, 50))
def test_every_window_has_one_row(parts, seed):
    """parse() covers each window once, and equal windows have equal cores."""
    rng = np.random.default_rng(seed)
    base = [[f"{chr(97 + k)}{rng.integers(0, 1 + 40 * k)}" for _ in range(300)] for k in range(4)]
    texts = [base[k][a:a + n] for k, a, n in parts]
    data = [(" " * int(rng.integers(0, 3)) + "\n ".join(t)).encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    rows = W.parse(np.frombuffer(b"".join(data), np.uint8), off)
    cores: dict[tuple, set] = {}
    for d, t in enumerate(texts):
        got = sorted((i, c) for x, a, b, c in zip(rows["doc"], rows["lo"], rows["hi"], rows["core"]) if x == d for i in range(a, b + 1))
        assert [i for i, _ in got] == list(range(max(0, len(t) - W.WORDS + 1)))
        for i, c in got:
            cores.setdefault(tuple(t[i:i + W.WORDS]), set()).add(c)
    assert all(len(c) == 1 for c in cores.values())


def test_staged_writes_leave_no_shuffle_files(spark):
    """Shuffle files of a written step waited for the driver's garbage collection before."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in top for f in glob.glob(os.path.join(d.getPath(), "*", "shuffle_*"))}
    before, kept = files(), spark.conf.get(common.DROP_SHUFFLES)
    out = common.staged(spark.range(10000).selectExpr("id % 7 k").groupBy("k").count(), "test", True)
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(common.DROP_SHUFFLES) == kept
    assert out.count() == 7
