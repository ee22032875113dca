"""Quality CRF: forward-backward against enumeration, held-out accuracy, odd inputs."""
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa

from paylake.llm import common, quality_crf as Q

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lens = np.array([3, 1, 4, 2])
    score, trans = rng.normal(size=lens.sum()), rng.normal(size=(2, 2))
    p, pairs, logz = Q.forward_backward(score, trans, lens)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lens:
        z, m, pp = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            e = sum((score[at + i] / 2) * (1 if y[i] else -1) for i in range(n))
            e = np.exp(e + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            z += e
            m += e * np.array(y)
            for i in range(n - 1):
                pp[y[i], y[i + 1]] += e
        want += list(m / z)
        want_pairs += pp / z
        want_z += np.log(z)
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(logz, want_z)


def test_features_do_not_depend_on_the_batch():
    texts = ["", "A b.\nA b.\n\nX!! Y!!", "a a a a", None, "é|è|ê\n", "\n\n", "1" * 5000]
    data, off = common.buffers(pa.array(texts, pa.string()))
    own, lens, per = Q.line_features(data, off)
    assert per.tolist() == [1, 4, 1, 1, 2, 3, 1] and len(own) == 13
    at = 0
    for t, k in zip(texts, per):
        d, o = common.buffers(pa.array([t], pa.string()))
        one, ln, _ = Q.line_features(d, o)
        assert np.allclose(one, own[at:at + k]) and (ln == lens[at:at + k]).all()
        at += k


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in Q.op2_quality(spark, SF).collect()}
    docs = common.table(spark, SF, "documents")
    assert len(out) == docs.count()
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(labels[i], r.predicted) for i, r in out.items() if i in labels and r.held_out]
    assert len(test) > 30 and sum(a == b for a, b in test) / len(test) > 0.95


def test_odd_rows_and_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "Good text here.\nMore of it."), (2, "x%%% y$$$ z***"), (3, None), (4, ""), (None, "null id"), (1, "Good text here.\nMore of it."),
            (5, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, predicted int")
    model = Q.train(docs, labels)
    out = Q.scored(docs, model, ["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    none = Q.train(docs, labels.filter("false"))
    assert {r.score for r in Q.scored(docs, none, ["doc_id"]).collect()} == {0.5}
    assert Q.scored(docs.filter("false"), model, ["doc_id"]).collect() == []
    assert os.path.isdir(SF)


def test_long_documents_are_in_the_sample(spark, monkeypatch):
    got = []
    monkeypatch.setattr(Q, "fit", lambda own, per_doc, label: got.append((list(per_doc), list(label))) or Q.Model(np.zeros(Q.FEATURES), np.zeros((2, 2))))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:4]
    docs = spark.createDataFrame([(ids[0], "a line\n" * 2999), (ids[1], "one"), (ids[2], None), (ids[3], "x\n" * (Q.SAMPLE_LINES + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    Q.train(docs, labels)
    assert sorted(got[0][0]) == [1, 1, 3000] and got[0][1] == [1, 1, 1]
    assert Q.fitting([(1, 1, 6), (2, 2, 5), (3, 3, 4)], 10) == [(1, 1), (3, 3)]


def test_mixed_neighbours_teach_the_transitions():
    """Lines whose labels alternate, or stay, with features that say little: the chain learns which."""
    rng = np.random.default_rng(2)
    for stay in (0.1, 0.9):
        per_doc = rng.integers(5, 30, 300)
        y = []
        for n in per_doc:
            y.append(int(rng.integers(2)))
            for _ in range(int(n) - 1):
                y.append(y[-1] if rng.random() < stay else 1 - y[-1])
        own = rng.normal(size=(len(y), Q.OWN)).astype(np.float32)
        own[:, 0] += 0.3 * np.array(y)
        t = Q.fit_lines(own, per_doc, np.array(y)).trans
        apart = t[0, 1] + t[1, 0] - t[0, 0] - t[1, 1]
        assert (apart > 0.5) if stay < 0.5 else (apart < -0.5)


def test_gradient_is_that_of_the_weighted_likelihood():
    """At the fitted weights no small step along a transition raises the regularised likelihood by much."""
    rng = np.random.default_rng(3)
    per_doc, label = rng.integers(1, 12, 60), rng.integers(0, 2, 60)
    own = rng.normal(size=(per_doc.sum(), Q.OWN)).astype(np.float32) + 0.5 * np.repeat(label, per_doc)[:, None]
    m = Q.fit(own, per_doc, label)
    x, y = Q.with_neighbours(own, per_doc).astype(float), np.repeat(label, per_doc)
    doc = np.repeat(np.arange(60), per_doc)
    good = label.mean()
    chain = np.where(label > 0, 0.5 / good, 0.5 / (1 - good)) / per_doc / 60

    def objective(trans):
        total = -Q.TRANSITION_L2 / 2 * (trans**2).sum()
        score = x @ m.weights
        for d in range(60):
            at = np.flatnonzero(doc == d)
            _, _, logz = Q.forward_backward(score[at], trans, np.array([len(at)]))
            own_score = (score[at] / 2 * (2 * y[at] - 1)).sum() + sum(trans[a, b] for a, b in zip(y[at][:-1], y[at][1:]))
            total += chain[d] * (own_score - logz)
        return total

    at = objective(m.trans)
    for i, j in itertools.product((0, 1), repeat=2):
        for step in (-0.2, 0.2):
            moved = m.trans.copy()
            moved[i, j] += step
            assert objective(moved) < at + 1e-3


def test_query_equals_enumeration_of_labels(spark):
    """op2's scores of short documents: every labelling of their lines, weighted by line length."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    m = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.op2_quality(spark, SF).collect()}
    short = [r for r in docs.collect() if (r.text or "").count("\n") < 8][:120]
    assert len(short) > 50
    for r in short:
        data, off = common.buffers(pa.array([r.text], pa.string()))
        own, lengths, per_doc = Q.line_features(data, off)
        score = Q.with_neighbours(own, per_doc).astype(float) @ m.weights
        n, z, mean = len(score), 0.0, np.zeros(len(score))
        for y in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(s / 2 * (1 if k else -1) for s, k in zip(score, y)) + sum(m.trans[a, b] for a, b in zip(y, y[1:])))
            z, mean = z + e, mean + e * np.array(y)
        want = ((lengths + 1.0) * mean / z).sum() / (lengths + 1.0).sum()
        assert abs(got[r.doc_id] - min(max(want, 0), 1)) < 1e-9
