"""Mixing: targets, permutations, and the whole operator against a plain model."""
import re

import numpy as np
import pytest

from paylake.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_stop_at_twice_and_reshare():
    t = M.targets([10, 1000, 1000])
    assert t[0] == 20 and abs(sum(t) - 1.5 * 2010) < 1e-9
    assert abs(t[1] / t[2] - 2) < 1e-9 or t[1] == 2000
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0]
    # one source alone: 150 %
    assert M.targets([100]) == [150]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_one_and_has_its_inverse(n):
    j = np.arange(n)
    key = np.full(n, 12345)
    p = M.permuted(j, np.full(n, n), key)
    assert sorted(p) == list(range(n))
    assert (M.unpermuted(p, np.full(n, n), key) == j).all()


def test_draws_sum_to_slots():
    c = M.draw_shards([100, 7, 0, 900], 9, 1)
    assert c.sum(axis=0).tolist() == [100, 7, 0, 900]
    assert M.draw_shards([], 1, 1).shape == (1, 0)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block long")


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        src = "hot" if i % 3 == 0 else [None, "a", "b", "tiny"][i % 4 if i % 4 < 3 or i < 8 else 1]
        text = " ".join(f"w{i}_{j}" for j in range(int(rng.integers(0, 300))))
        rows.append((i, text, "en", src, len(text), 1))
    rows += [(1, None, None, "a", None, 1), (None, "x y z", "en", "b", 5, 1), (7, "same row", "en", "a", 8, 1),
             (7, "same row", "en", "a", 8, 1), (9, "word " * 5000, "en", "b", 25000, 1)]
    df = docs(spark, rows)
    out = M.Mix(df).taken().collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), 0)
        by[(r.source_size, r.target)] += r.taken
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 1
    again = M.Mix(df.repartition(7)).taken().collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    # the documents of the mix hold exactly the words counted
    mixed = M.mix_documents(df).collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == sum(r.taken for r in out)
    whole = {(r.doc_id, r.size) for r in out if r.taken == 2 * r.size and r.size}
    texts = {(r[0], len(WORD.findall(r[1] or ""))): r[1] for r in rows}
    for r in mixed:
        for key_ in whole:
            if key_[0] == r.doc_id and r.doc_id not in (None, 7, 1):
                assert r.text == texts[key_] + "\n" + texts[key_]


def test_empty_table(spark):
    assert M.Mix(docs(spark, [])).taken().collect() == []
    assert M.mix_documents(docs(spark, [])).collect() == []


def test_taken_words_equal_a_plain_model_of_blocks(spark):
    """Every slot's block walked word by word: who owns each word, how often it is taken."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        n = int(rng.integers(0, 40))
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(n)), "en", ["hot", "hot", "a", "b", None][i % 5], n, 1))
    rows += [(3, "same", "en", "a", 4, 1), (3, "same", "en", "a", 4, 1), (None, "no id", "en", "b", 5, 1), (500, None, "en", "a", 0, 1)]
    mix = M.Mix(docs(spark, rows), block=7, shard_slots=5)
    placed = mix.placed().collect()
    owner = [np.full(w, -1) for w in mix.words]
    for x, r in enumerate(placed):
        own = owner[r.source_no][r["at"]:r["at"] + r.size]
        assert (own == -1).all()                                  # places don't overlap
        own[:] = x
    assert all((o >= 0).all() for o in owner) and mix.shards > 5
    taken = np.zeros(len(placed), int)
    for k, words in enumerate(mix.words):
        left = mix.quota[k]
        seen = []
        for shard in range(mix.shards):
            for slot in range(int(mix.first_slot[shard, k]), int(mix.first_slot[shard + 1, k])):
                seen.append(slot)
                epoch, j = divmod(slot, mix.blocks[k])
                at = int(M.permuted(np.array([j]), np.array([mix.blocks[k]]), np.array([mix._key(k, epoch)]))[0])
                for word in range(at * 7, min(at * 7 + 7, words)):
                    if left:
                        taken[owner[k][word]] += 1
                        left -= 1
        assert seen == list(range(mix.slots[k])) and left == 0
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((r.doc_id, r.size, mix.words[r.source_no], float(mix.targets[r.source_no]), int(t)) for r, t in zip(placed, taken)), key=key)
    assert sorted((tuple(r) for r in mix.taken().collect()), key=key) == want
