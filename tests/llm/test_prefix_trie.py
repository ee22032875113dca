"""The splitter skeleton against a plain trie in Python, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from paylake.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def code(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """The nodes by sets of members, quadratic on purpose."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, code(r or "", x or ""), len(x or "")))
    own = {c: [(k, n) for _, _, k, n in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p],
                    sum(1 for q in below if not kids[q]), sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    """Conversations with a hot first turn, a hot whole one, families, nulls, ties and repeats."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.3:
            rows += [(c, t, "user", f"hot {t}") for t in range(4)]
            continue
        for t in range(rng.randint(1, 8)):
            text = "first é" if t == 0 and rng.random() < 0.5 else "w" * rng.randint(0, 3) + str(rng.randint(0, 2))
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([text, text, None])))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(None, 1, "user", "no id"), (-150, 0, "user", "x"), (-100, 0, "user", "x"), (10 ** 15 + 7, 0, None, None)]
    return rows


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_equals_plain_trie(spark, monkeypatch, shards):
    monkeypatch.setattr(T, "CHUNK_IDS", 3)
    rows = made(shards, 330)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        got = T.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_short_splitters_and_shards_in_memory():
    """Splitters cut short, and every shard by itself: the same nodes."""
    rows = made(5, 200)
    whole = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            whole[c].append((bytes.fromhex(code(r or "", x or ""))[:16], len(x or "")))
    items = sorted((b"".join(k for k, _ in v), c, [n for _, n in v]) for c, v in whole.items())
    ends = sorted({(k[:2 * T.DIGEST], c) for k, c, _ in items[::9]})
    trie, out = T.skeleton(ends), []
    for number in range(len(ends) + 1):
        shard = T.Shard(number, trie, out)
        for k, c, chars in items:
            if T.bisect_right(ends, (k, c)) == number:
                shard.path(k, chars, c)
        shard.end()
    keys = {k[:d] for k, _, _ in items for d in range(0, len(k) + 1, T.DIGEST)}
    tops = {r[1] for r in out if r[0] == T.PART}
    assert len(keys) == len(tops) + sum(r[0] in (T.DONE, T.BELOW) for r in out)
    assert sum(r[5] for r in out if r[0] == T.PART and r[1] == b"") == len(items)


def test_odd_tables(spark):
    assert T.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    long = [(100 + (i % 3), i, "user", f"turn {i // 3}") for i in range(3000)] + [(103, 0, "user", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, "clash", b"k", 7) for r in long], SCHEMA + ", key string, codes binary, depth int")
    assert sorted((tuple(r) for r in T.trie(df).collect()), key=str) == plain_chain(long)


def plain_chain(rows):
    """As plain(), for long paths: subtrees summed from the leaves up."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, code(r, x), len(x)))
    own = {c: [(k, n) for _, k, n in sorted(v)] for c, v in own.items()}
    whole = {c: own.get(c - c % 100, [])[:zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6:] for c, v in own.items()}
    members, parent, chars, ends = defaultdict(list), {}, {"": 0}, defaultdict(list)
    for c in sorted(whole):
        key = ""
        members[key].append(c)
        for k, n in whole[c]:
            up, key = key, hashlib.md5((key + k).encode()).hexdigest()
            parent[key], chars[key] = up, n
            members[key].append(c)
        ends[key].append(c)
    depth = {"": 0}
    order = list(dict.fromkeys(members))
    for key in order:
        if key:
            depth[key] = depth[parent[key]] + 1
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in sorted(order, key=lambda x: -depth[x]):
        leaves[key] += not kids[key]
        saved[key] += (len(members[key]) - 1) * chars[key]
        if key:
            up = parent[key]
            kids[up] += 1
            leaves[up] += leaves[key]
            saved[up] += saved[key]
    return sorted(((min(members[k]), depth[k], min(members[parent[k]]) if k else None, len(members[k]), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k in order), key=str)


def test_registered_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = [tuple(r) for r in T.op13_prefix_trie(spark, sf_dir).collect()]
    want = duckdb.sql(T.oracle(f"read_parquet('{sf_dir}/conversations.parquet')")).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=str) == plain_chain(rows)
