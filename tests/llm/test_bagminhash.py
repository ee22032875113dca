"""BagMinHash: unbiased weighted Jaccard, batch independence, classes against all pairs."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paylake.llm import bagminhash as B, common


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


@pytest.mark.parametrize("scale", [1, 3, 0.4])
def test_signatures_estimate_weighted_jaccard(scale):
    rng = np.random.default_rng(5)
    h = common.mix64(np.arange(60, dtype=np.uint64) + np.uint64(9))
    wa, wb = rng.integers(0, 9, 60) * scale, rng.integers(0, 9, 60) * scale
    doc = np.repeat([0, 1], 60)
    w = np.concatenate([wa, wb])
    keep = w > 0
    sig = B.signatures(doc[keep], np.concatenate([h, h])[keep], w[keep], 2, size=6000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_signature_of_a_text_does_not_depend_on_the_batch():
    texts = ["a b c d e f g h", "", None, "x", "a b c d e f g h", "word " * 3000, "É é\tb c\nd e"]
    arr = pa.array(texts, pa.string())
    doc, h, n = B.multisets(arr)
    sig = B.signatures(doc, h, n, len(texts))
    for i, t in enumerate(texts):
        d, hh, nn = B.multisets(pa.array([t], pa.string()))
        assert (B.signatures(d, hh, nn, 1)[0] == sig[i]).all()
        assert sorted(nn) == sorted(bag(t).values())
    assert (sig[0] == sig[4]).all()


def corpus():
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = [(None, "null id text of six words"), (900, None), (901, ""), (902, " \n"), (903, None)]
    i = 0
    for group in range(12):
        base = text(int(rng.integers(40, 300)))
        for _ in range(int(rng.integers(1, 12)) if group else 60):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 40))):
                t[int(rng.integers(len(t)))] = f"n{rng.integers(10**6)}"
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(0, rows[5][1]), (5, rows[5][1]), (950, "few words"), (951, "Few  WORDS"), (952, "few word")]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, class_id string, rep long").repartition(6)
    out = B.near_duplicates(df).collect()
    assert len(out) == len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if bag(rows[x][1]) and jaccard(rows[x][1], rows[y][1]) >= 0.8:
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        r = find(x)
        ids = [v for v in (least.get(r), i) if v is not None]
        least[r] = min(ids) if ids else None
    key = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or 0)
    want = sorted(((i, least[find(x)]) for x, (i, _) in enumerate(rows)), key=key)
    assert sorted(((r.doc_id, r.class_id) for r in out), key=key) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.near_duplicates(df).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in B.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_random_links(spark):
    """Stars whose centre is the largest or smallest node, trees, cycles, repeated links, loops."""
    rng = np.random.default_rng(6)
    pairs = [(int(x), int(y)) for x, y in rng.integers(0, 400, (260, 2))]
    pairs += [(999, i) for i in range(500, 540)] + [(600, i) for i in range(601, 640)] + [(7, 7), (700, 700)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        parent[find(x)] = find(y)
    got = {r.node: r.comp for r in B.components(spark.createDataFrame(pairs + pairs[:50], "a long, b long")).collect()}
    linked = {v for x, y in pairs if x != y for v in (x, y)}
    assert set(got) == linked
    groups = lambda label: {frozenset(v for v in linked if label(v) == c) for c in map(label, linked)}
    assert groups(got.get) == groups(find)
    assert all(got[c] == c for c in got.values())
    assert B.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_prefix_filter_loses_no_pair_and_lists_few(spark):
    """A group of texts around 0.8 to one another: every pair of overlap 0.8 meets, most others don't."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 40, 150)]           # repeated words: shingles with counts
    base += base[:30]
    texts = []
    for i in range(90):
        t = base[: len(base) - int(rng.integers(0, 12))]
        for _ in range(int(rng.integers(0, 9))):
            t[int(rng.integers(len(t)))] = f"n{rng.integers(10**6)}"
        texts.append(" ".join(t))
    texts = sorted(set(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "rep long, text string").repartition(4)
    members = frame.selectExpr("rep", "rep as comp", "array(rep div 45) as buckets")
    got = {(r.a, r.b) for r in B.meeting(members, frame, 0.8).collect()}
    same = [(x, y) for y in range(len(texts)) for x in range(y) if x // 45 == y // 45]
    near = {p for p in same if jaccard(texts[p[0]], texts[p[1]]) >= 0.8}
    assert near and near <= got <= set(same)
    assert len(got) < 0.8 * len(same)


def test_classes_of_a_group_around_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(int(rng.integers(0, 8))):
            t[int(rng.integers(len(t)))] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.class_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = {i: i for i, _ in rows}
    for y, b in rows:
        for x, a in rows[:y]:
            if jaccard(a, b) >= 0.8 and label[x] != label[y]:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = {k: new if v == old else v for k, v in label.items()}
    assert got == label


def test_verified_pairs_grow_in_proportion(spark, monkeypatch):
    """Edited copies of one text, four times as many: the pairs that are verified stay a few a copy."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    listed = []
    real = B.overlaps
    monkeypatch.setattr(B, "overlaps", lambda texts, pairs: listed.append(pairs.count()) or real(texts, pairs))
    each = {}
    for n in (150, 600):
        rows = []
        for i in range(n):
            t = list(base)
            for _ in range(int(rng.integers(0, 8))):
                t[int(rng.integers(len(t)))] = f"n{rng.integers(10**6)}"
            rows.append((i, " ".join(t)))
        listed.clear()
        B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
        each[n] = sum(listed) / n
    assert each[600] < 1.6 * each[150] and each[600] < 20, each
