"""The trie of conversation prefixes, by a splitter skeleton.

A rebuilt conversation is a path of turn digests.  Paths are range-partitioned by
splitters ``(path, conv_id)`` taken from a sample, so that one path held by any
number of conversations is spread as well.  A node whose members lie in several
shards is a prefix of the splitter between them; so the trie of all splitter
paths (the skeleton, broadcast) tells which nodes a shard can't finish.  A shard
reads its sorted paths once with a stack of open nodes and finishes every other
node; for skeleton nodes the shards give partial aggregates, which are reduced,
summed up along the skeleton, and joined to their children.

A turn is known by 128 bits of the SHA-256 of its role and text (two different
turns are taken for one with a probability below 1e-14 among 10^12 turns).

Results for odd input: rows without ``conv_id`` take no part; null role or text
is empty; turns of equal number (or none) go by their digest, repeated rows stay
as turns of their own.  A conversation that rebuilds to nothing is a member of
the root alone.  ``conv_id - conv_id % 100`` rounds negative ids towards zero.
An empty table has no nodes.  Further columns are not read.  Texts of any length
are read once, as digest and length.  Memory: a task holds the open nodes of one
path (about 250 bytes a turn of its longest conversation) and, of its own shard,
the finished children of open nodes.  Copies of one path of more than
``SPLITTER_TURNS`` turns stay in one shard.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A conversation takes up to HEADS - 1 first turns of the one that leads its FAMILY ids.
FAMILY, HEADS = 100, 6
#: Bytes of a turn's digest.
DIGEST = 16
#: Sampled paths, and turns of a path that a splitter keeps: 64 MB at most come to
#: the driver and go out again.
SAMPLE_KEYS = 16_000
SPLITTER_TURNS = 256
#: Conversation ids that one row carries on the way to a skeleton node's hash.
CHUNK_IDS = 1_000
#: Rows that a shard hands on together.
OUT_ROWS = 10_000

NO_ENDS = hashlib.sha256(b"").hexdigest()

#: Rows that shards give: finished nodes, finished nodes below a skeleton node
#: (``key``: that node), parts of skeleton nodes, ids that end in them.
DONE, BELOW, PART, ENDS = range(4)
_SHARD_OUT = ("kind int, key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
              "n_leaves long, saved_tokens long, chars long, shard int, seq long, ends_sha256 string")
_NAMES = [c.split()[0] for c in _SHARD_OUT.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]
          for c in _SHARD_OUT.split(", ")]
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, codes, chars): each conversation's turns in order, as digests and lengths."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = (conversations.filter(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.unhex(F.substring(digest, 1, 2 * DIGEST)).alias("code"), F.length(text).cast("long").alias("chars")))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code", "chars"))).alias("t"))
    return listed.select("conv_id", F.col("t.code").alias("codes"), F.col("t.chars").alias("chars"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, codes, chars) with the family's first turns in place of the own ones."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = (own.filter(F.col("conv_id") % FAMILY == 0)
             .select(F.col("conv_id").alias("family"), F.slice("codes", 1, HEADS - 1).alias("head_codes"),
                     F.slice("chars", 1, HEADS - 1).alias("head_chars")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")

    def put(own_col: str, head_col: str, kind: str):
        head = F.coalesce(F.slice(head_col, F.lit(1), h), F.array().cast(f"array<{kind}>"))
        return F.concat(head, F.slice(own_col, h + 1, F.size(own_col))).alias(own_col)

    return (own.withColumn("family", family).join(heads, "family", "left")
            .select("conv_id", put("codes", "head_codes", "binary"), put("chars", "head_chars", "bigint")))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, chars): a path's digests one after the other, its turns' lengths."""
    own = common.staged(own_turns(conversations), "trie-own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes")
            off = codes.offsets.to_numpy(zero_copy_only=False).astype(np.int64) * DIGEST
            raw = codes.values                                # digests of one length: one stretch of bytes
            starts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:] if len(raw) else np.zeros(1, np.int32)
            data = raw.buffers()[2].to_pybytes() if len(raw) else b""
            keys = [data[starts[0] + a:starts[0] + b] for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, pa.binary()), batch.column("chars")],
                                             names=["conv_id", "key", "chars"])

    return common.staged(rebuilt(own).mapInArrow(run, "conv_id long, key binary, chars array<long>"), "trie-paths")


def splitters(keyed: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Ends of the shards, from a sample of bounded size drawn by hash."""
    sample = (keyed.select(F.expr(f"substring(key, 1, {DIGEST * SPLITTER_TURNS})").alias("key"), "conv_id")
              .orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE_KEYS).collect())
    rows = sorted((bytes(r["key"]), r["conv_id"]) for r in sample)
    return sorted({rows[len(rows) * i // shards] for i in range(1, shards)}) if rows else []


def skeleton(ends: list[tuple[bytes, int]]) -> dict:
    """The trie of the splitters' paths: digest -> subtrie."""
    root: dict = {}
    for key, _ in ends:
        node = root
        for a in range(0, len(key), DIGEST):
            node = node.setdefault(key[a:a + DIGEST], {})
    return root


class Node:
    """An open node: members so far, what its finished children add up to."""

    __slots__ = ("chars", "trie", "n", "low", "kids", "leaves", "saved", "ends", "done")

    def __init__(self, chars: int, trie: dict | None):
        self.chars, self.trie = chars, trie                  # trie: of a skeleton node
        self.n, self.low, self.kids, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends = None                                     # running hash; of a skeleton node the ids not handed on
        self.done = None                                     # finished children

    def add(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)


class Shard:
    """Finishes the nodes of one shard from its paths in order."""

    def __init__(self, number: int, trie: dict, out: list):
        self.number, self.out = number, out
        self.stack, self.key, self.seq = [Node(0, trie)], b"", 0

    def path(self, key: bytes, chars: list[int], conv_id: int) -> None:
        same = 0
        most = min(len(self.stack) - 1, len(key) // DIGEST)
        while same < most and key[same * DIGEST:(same + 1) * DIGEST] == self.key[same * DIGEST:(same + 1) * DIGEST]:
            same += 1
        while len(self.stack) - 1 > same:
            self.close()
        for d in range(same, len(key) // DIGEST):
            trie = self.stack[-1].trie
            self.stack.append(Node(chars[d], trie.get(key[d * DIGEST:(d + 1) * DIGEST]) if trie is not None else None))
        self.key = key
        top = self.stack[-1]
        top.add(1, conv_id)
        if top.trie is not None:
            top.ends = top.ends or []
            top.ends.append(conv_id)
            if len(top.ends) >= CHUNK_IDS:
                self.hand_on(top, key)
        elif top.ends is None:
            top.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            top.ends.update(b",%d" % conv_id)

    def hand_on(self, node: Node, key: bytes) -> None:
        if node.ends:
            self.out.append((ENDS, key, None, None, None, None, None, None, None, None, self.number, self.seq,
                             ",".join(map(str, node.ends))))
            self.seq += 1
            node.ends = None

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.trie is not None:
            key = self.key[:depth * DIGEST]
            self.hand_on(node, key)
            if node.n:
                self.out.append((PART, key, node.low, depth, None, node.n, node.kids, node.leaves, node.saved, node.chars,
                                 None, None, None))
                if self.stack:
                    self.stack[-1].add(node.n, node.low)
            return
        parent = self.stack[-1]
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.chars
        for row in node.done or ():
            self.out.append((DONE, None, row[0], row[1], node.low, *row[2:]))
        row = (node.low, depth, node.n, node.kids, leaves, saved, None, None, None,
               node.ends.hexdigest() if node.ends is not None else NO_ENDS)
        parent.add(node.n, node.low)
        parent.kids += 1
        parent.leaves += leaves
        parent.saved += saved
        if parent.trie is not None:
            self.out.append((BELOW, self.key[:(depth - 1) * DIGEST], row[0], row[1], None, *row[2:]))
        else:
            parent.done = parent.done or []
            parent.done.append(row)

    def end(self) -> None:
        while self.stack:
            self.close()


def shard_rows(keyed: DataFrame, ends: list[tuple[bytes, int]], shards: int) -> DataFrame:
    """What the shards give (``_SHARD_OUT``): every task finishes the shards dealt to it."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(ends, x) for x in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["shard", "conv_id", "key", "chars"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, open_shard = skeleton(ends), [], None

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        for batch in batches:
            for number, conv_id, key, chars in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "key", "chars"))):
                if open_shard is None or open_shard.number != number:
                    if open_shard:
                        open_shard.end()
                    open_shard = Shard(number, trie, out)
                open_shard.path(key, chars, conv_id)
                if len(out) >= OUT_ROWS:
                    yield batch_of(out)
                    out.clear()
        if open_shard:
            open_shard.end()
        for a in range(0, len(out), OUT_ROWS):
            yield batch_of(out[a:a + OUT_ROWS])

    dealt = keyed.mapInArrow(deal, "shard int, conv_id long, key binary, chars array<long>")
    return (dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "conv_id")
            .mapInArrow(finish, _SHARD_OUT))


def ends_hashes(chunks: DataFrame, shards: int) -> DataFrame:
    """(key, ends_sha256) of skeleton nodes: their ids' chunks, streamed in order
    through one hash a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])],
                                              names=["key", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ends_sha256").to_pylist()):
                if state is not None and k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    yield row()
                key, state = k, hashlib.sha256(ids.encode())
        if state is not None:
            yield row()

    return (chunks.select("key", "shard", "seq", "ends_sha256").repartition(shards, "key")
            .sortWithinPartitions("key", "shard", "seq").mapInArrow(run, "key binary, ends_sha256 string"))


def reduced(rows: DataFrame, shards: int) -> DataFrame:
    """The skeleton's nodes from the shards' parts, with ``key`` and ``parent_key``."""
    parts = (rows.filter(F.col("kind") == PART).groupBy("key")
             .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
                  *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
             .withColumn("parent_key", F.when(F.col("depth") > 0, F.expr(f"substring(key, 1, int({DIGEST} * (depth - 1)))"))))
    parts = common.staged(parts, "trie-skeleton")
    kids = (parts.filter("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more_children")))
    nodes = (parts.join(kids, "key", "left")
             .withColumn("n_children", F.col("n_children") + F.coalesce("more_children", F.lit(0))))
    # what a node itself adds to the subtrees of all nodes on its path
    own = (nodes.select(F.explode(F.sequence(F.lit(0), F.col("depth").cast("int"))).alias("d"), "key",
                        (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
                        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
           .groupBy(F.expr(f"substring(key, 1, {DIGEST} * d)").alias("key"))
           .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    hashes = ends_hashes(rows.filter(F.col("kind") == ENDS), shards)
    return (nodes.drop("n_leaves", "saved_tokens").join(own, "key").join(hashes, "key", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations (columns ``COLUMNS``)."""
    spark = conversations.sparkSession
    common.prepare(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = paths(conversations)
    rows = common.staged(shard_rows(keyed, splitters(keyed, shards), shards), "trie-nodes")
    top = common.staged(reduced(rows, shards), "trie-top")
    names = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    below = (rows.filter(F.col("kind") == BELOW).withColumnRenamed("key", "parent_key").drop("parent_conv_id")
             .join(names, "parent_key").withColumnRenamed("of_parent", "parent_conv_id"))
    upper = top.join(names, "parent_key", "left").withColumnRenamed("of_parent", "parent_conv_id")
    return (rows.filter(F.col("kind") == DONE).select(*COLUMNS)
            .unionByName(below.select(*COLUMNS)).unionByName(upper.select(*COLUMNS)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie(common.table(spark, sf_dir, "conversations"))


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for the same rows, by grouping all prefixes of all paths."""
    crc = """xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])),
             lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384)
                                                                                 ELSE x >> 1 END)))"""
    return f"""
WITH turns AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
                      length(coalesce(text, '')) AS chars FROM {table} WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(code ORDER BY turn NULLS FIRST, code) AS codes, list(chars ORDER BY turn NULLS FIRST, code) AS chars
        FROM turns GROUP BY conv_id),
steps AS (SELECT *, conv_id - conv_id % {FAMILY} AS family, conv_id::VARCHAR AS s FROM own),
heads AS (SELECT *, ({crc}) % {HEADS} AS h FROM steps),
paths AS (SELECT a.conv_id, coalesce(b.codes, [])[1:a.h] || a.codes[a.h + 1:] AS codes,
                 coalesce(b.chars, [])[1:a.h] || a.chars[a.h + 1:] AS chars
          FROM heads a LEFT JOIN own b ON a.family = b.conv_id),
steps2 AS (SELECT conv_id, codes, chars, unnest(range(0, len(codes) + 1)) AS depth FROM paths),
nodes AS (SELECT codes[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(codes) = depth), '')) AS ends_sha256,
                 max(CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END) AS chars
          FROM steps2 GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
up AS (SELECT p[1:d] AS p, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
       FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs,
       a.n_children::BIGINT AS n_children, up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN up USING (p) LEFT JOIN nodes b ON a.depth > 0 AND b.p = a.p[1:a.depth - 1]"""
