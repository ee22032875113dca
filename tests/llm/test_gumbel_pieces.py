"""Sampled segmentations: round trips, distinctness, and their distribution."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from paylake.llm import gumbel_pieces as G

TEXTS = ["Hello world", "  two  blanks\n\ttab ", "漢字 é𝄞 mix", "", None, "a", "▁odd ▁ sign", "thntblere " * 400, "x" * 3000, "the " * 2000, " "]


def rows(spark):
    return spark.createDataFrame([(i, t, 1, "d") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "d"), (0, "Hello world", 2, "e")],
                                 "doc_id long, text string, draw int, decoded string")


def test_round_trip_distinct_and_repeatable(spark):
    got = G.decode(G.sample(rows(spark), k=3)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=G.default_model())
    by = {}
    for r in got:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            assert r.decoded == text.replace("▁", " ")
            assert sp.decode(r.ids) == text.replace("▁", " ") if text else r.ids == []
            by.setdefault(r.doc_id, set()).add(tuple(r.ids))
        assert 0 < r.inclusion <= 1
    assert all(len(by[i]) == 3 for i in (0, 1, 7, 8, 9)) and len(by[3]) == 1
    again = G.sample(rows(spark).repartition(5), k=3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.draw, tuple(r.ids))
    assert sorted(map(key, got)) == sorted(map(key, again))


def every(voc, word):
    edges, n = voc._lattice(word), len(word)

    def walk(p):
        if p == n:
            yield ()
            return
        for i, to in edges[p]:
            for rest in walk(to):
                yield (i,) + rest
    out = {seg: float(np.exp(sum(voc.cost(i) for i in seg))) for seg in walk(0)}
    z = sum(out.values())
    return {k: v / z for k, v in out.items()}


@pytest.mark.parametrize("text", ["on at", "ther", "é漢t"])
def test_draws_follow_sampling_without_replacement(text):
    voc = G.Vocabulary(G.default_model())
    words = G.words_of(text)
    probs = {(): 1.0}
    for w in words:
        probs = {a + b: p * q for a, p in probs.items() for b, q in every(voc, w).items()}
    n = 3000
    first, second = Counter(), Counter()
    roots = voc.roots(words)
    for s in range(n):
        a, b = G.Sampler(voc, roots, s * 7919 + 13).run(2)
        ids = [tuple(voc.piece[r["edges"]].tolist()) for r in (a, b)]
        assert ids[0] != ids[1] and a["value"] >= b["value"]
        assert np.isclose(np.exp(a["log_prob"]), probs[ids[0]])
        first[ids[0]] += 1
        second[ids[1]] += 1
    for seg, p in probs.items():
        assert abs(first[seg] / n - p) < 0.045
        want = sum(q * p / (1 - q) for other, q in probs.items() if other != seg)
        assert abs(second[seg] / n - want) < 0.045


def test_all_segmentations_when_there_are_few():
    voc = G.Vocabulary(G.default_model())
    words = G.words_of("at")
    got = G.Sampler(voc, voc.roots(words), 5).run(50)
    want = every(voc, words[0])
    assert {tuple(voc.piece[r["edges"]].tolist()) for r in got} == set(want)
    assert all(r["inclusion"] == 1.0 for r in got) and np.isclose(sum(np.exp(r["log_prob"]) for r in got), 1)


def test_empty_table(spark):
    assert G.decode(G.sample(rows(spark).filter("false"))).collect() == []


def test_split_equals_words_of():
    rng = np.random.default_rng(2)
    texts = [None, "", " ", "a", "  two  blanks ", "x▁y ▁", "line\nend\n", "é 日本 x"]
    texts += ["".join(rng.choice(list("ab \n▁é"), int(rng.integers(0, 30)))) for _ in range(200)]
    words, which, cut = G.split(pa.array(texts, pa.string()).slice(1))
    for i, t in enumerate(texts[1:]):
        assert [words[j] for j in which[cut[i]:cut[i + 1]]] == G.words_of((t or "").replace("▁", " "))
    assert len(set(words)) == len(words)
    assert [len(x) for x in G.split(pa.array([None, ""], pa.string()))] == [0, 0, 3]


def lattice(voc, node):
    """All edges below a node: (piece, log p, what follows)."""
    if node < 0:
        return ()
    a, n = voc.first[node], voc.count[node]
    return tuple((int(voc.piece[e]), round(float(voc.given[e]), 9), lattice(voc, int(voc.to[e]))) for e in range(a, a + n))


def test_shared_suffixes_change_no_lattice(monkeypatch):
    words = ["▁nation", "▁station", "tion", "▁ion\n", "▁é日", "▁", "ation", "▁nations"]
    voc = G.Vocabulary(G.default_model())
    shared = [lattice(voc, int(r)) for part in (words[:3], words[3:], words) for r in voc.roots(part)]
    small = voc.nodes
    alone = G.Vocabulary(G.default_model())
    monkeypatch.setattr(G.Vocabulary, "_suffixes", lambda self, text, left: (np.zeros(len(text), np.uint64), np.arange(len(text)), np.arange(len(text))))
    assert shared == [lattice(alone, int(r)) for part in (words[:3], words[3:], words) for r in alone.roots(part)]
    assert small < alone.nodes
    monkeypatch.undo()
    collide = G.Vocabulary(G.default_model())
    real = G.Vocabulary._suffixes
    # one hash for all suffixes of the same number in a batch: known nodes don't match and nothing is shared
    monkeypatch.setattr(G.Vocabulary, "_suffixes", lambda self, text, left: (lambda k, a, w: (np.arange(1, len(k) + 1, dtype=np.uint64), a, w))(*real(self, text, left)))
    assert shared == [lattice(collide, int(r)) for part in (words[:3], words[3:], words) for r in collide.roots(part)]
