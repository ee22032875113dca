"""Mixing sources to target weights with fixed-length blocks.

The words of a source, documents in a fixed order, form one stream that is
packed into blocks of ``BLOCK_WORDS`` words.  Every source has a target (words
the mix takes from it), which is a number of slots, one block each, the last
one cut to length.  For every output shard a multinomial draw (over what each
source still has to give) says how many of its slots come from which source.
The slots of a source are numbered through over the shards; slot ``j`` takes
block ``permutation(j mod blocks)`` of its source, where the permutation is a
seeded pseudorandom one per pass over the source.  Blocks are joined by index.

A word belongs to one block and a block is used at most once per pass; the
targets stop at two passes, so no document gives more than twice its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the task: weights by source in code point order, the share of
#: all words that the mix takes, and the most passes over a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
WORD = r"[^\x20\x09-\x0D]+"

BLOCK_WORDS = 64
#: Slots of one output shard, about (one task each).
SHARD_SLOTS = 50_000
SEED = 20


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> list[float]:
    """Words to take from each source (sizes in source order): ``share`` of all
    words by weight; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight, until none is above."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = most * np.array(sizes, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = share * float(sum(sizes))
    while open_.any():
        want = np.where(open_, left * weight / weight[open_].sum(), 0)
        over = open_ & (want > cap)
        if not over.any():
            return np.where(open_, want, out).tolist()
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return out.tolist()


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, for arrays: four Feistel
    rounds over the next even power of two, walked until below n."""
    return _walk(j, n, key, False)


def unpermuted(b: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The inverse: the index that ``permuted`` maps to ``b``."""
    return _walk(b, n, key, True)


def _walk(j: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    half = (np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1)).astype(np.int64) + 1) // 2
    mask = (np.uint64(1) << half.astype(np.uint64)) - np.uint64(1)
    x, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        i = np.flatnonzero(todo)
        h, m, k = half[i].astype(np.uint64), mask[i], key[i].astype(np.uint64)
        left, right = x[i] >> h, x[i] & m

        def keyed(v: np.ndarray, r: int) -> np.ndarray:
            return common.mix64(v + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m

        for r in range(4):
            if back:
                left, right = right ^ keyed(left, 3 - r), left
            else:
                left, right = right, left ^ keyed(right, r)
        x[i] = (left << h) | right
        todo[i] = x[i] >= n[i].astype(np.uint64)
    return x.astype(np.int64)


def draw_shards(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: for each shard a multinomial draw in proportion
    to the slots that sources have left, what exceeds a source's rest going to
    the others; the columns sum to ``slots``."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for s in range(shards):
        need = -(-int(left.sum()) // (shards - s))
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[s] += got
            left -= got
            need -= int(got.sum())
    return out


class Mix:
    """The plan of a mix over ``docs`` (doc_id, text, source).

    Sizes and positions are DataFrames; only the per-source totals (one row per
    distinct source) and the shards' counts come to the driver.

    A null or empty text has size 0 and is never taken from; null sources are one
    source, the last.  Rows equal in id, text and source have places of their own;
    rows that differ in further columns alone are paired with the words taken by
    rank.  Texts of any length are counted and cut whole.
    """

    def __init__(self, docs: DataFrame, seed: int = SEED, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS):
        self.spark, self.seed, self.block = docs.sparkSession, seed, block
        common.prepare(self.spark)
        text = F.col("text").cast("string")
        sized = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.xxhash64(text).alias("th"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        self.sized = common.staged(sized, "mix-sizes")
        # one row per source: bounded by the number of sources, not by documents
        rows = self.sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
        self.sources = [r.source for r in rows]
        self.words = [int(r.words) for r in rows]
        self.targets = targets(self.words)
        self.quota = [round(t) for t in self.targets]
        self.blocks = [-(-w // block) for w in self.words]
        # the last block of a source is shorter: slots are counted through the passes
        self.slots = [self._slots(k) for k in range(len(rows))]
        self.shards = max(1, -(-sum(self.slots) // shard_slots))
        counts = draw_shards(self.slots, self.shards, seed)
        self.first_slot = np.vstack([np.zeros((1, len(rows)), np.int64), np.cumsum(counts, axis=0)])
        # a run has as many documents as its source has runs: neither grows faster than the root
        self.runs = [math.isqrt(int(r.docs)) + 1 for r in rows]

    def _slots(self, k: int) -> int:
        """Slots so that the blocks taken hold the quota."""
        words, full, quota = self.words[k], self.blocks[k], self.quota[k]
        if not words or not quota:
            return 0
        passes, rest = divmod(quota, words)
        if not rest:
            return passes * full
        j = -(-rest // self.block)                 # slots of the last pass if none is the short block
        return passes * full + (j if self._taken_in_pass(k, passes, j) >= rest else j + 1)

    def _taken_in_pass(self, k: int, epoch: int, j: int) -> int:
        """Words of the first ``j`` slots of a pass; the source's last block may be short."""
        full = self.blocks[k]
        short = self.block * full - self.words[k]
        at = unpermuted(np.array([full - 1]), np.array([full]), np.array([self._key(k, epoch)]))
        return j * self.block - (short if int(at[0]) < j else 0)

    def _key(self, k: int, epoch: int) -> int:
        return (self.seed * 1_000_003 + k) * 16 + epoch

    def slot_table(self) -> DataFrame:
        """(shard, slot, source_no, epoch, block, use): one row per slot of the
        mix; ``use`` is how many words of the block the slot takes."""
        first, slots, blocks, words, quota = self.first_slot, self.slots, self.blocks, self.words, self.quota
        block, seed = self.block, self.seed
        over = []                                   # words beyond the quota in the last slot of a source
        for k in range(len(slots)):
            if not slots[k]:
                over.append(0)
                continue
            passes, rest = divmod(slots[k], blocks[k])
            total = passes * words[k] + (self._taken_in_pass(k, passes, rest) if rest else 0)
            over.append(total - quota[k])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard in frame["id"]:
                    for k in range(len(slots)):
                        for a in range(int(first[shard, k]), int(first[shard + 1, k]), 200_000):
                            slot = np.arange(a, min(int(first[shard + 1, k]), a + 200_000), dtype=np.int64)
                            epoch, j = np.divmod(slot, blocks[k])
                            n = np.full(len(j), blocks[k], np.int64)
                            at = permuted(j, n, (seed * 1_000_003 + k) * 16 + epoch)  # as _key
                            use = np.minimum(block, words[k] - at * block)
                            use = use - np.where(slot == slots[k] - 1, over[k], 0)
                            yield pd.DataFrame({"shard": np.int64(shard), "slot": slot, "source_no": np.int64(k),
                                                "epoch": epoch, "block": at, "use": use})

        # one shard is one task
        return (self.spark.range(0, self.shards, 1, self.shards)
                .mapInPandas(common.released(run), "shard long, slot long, source_no long, epoch long, block long, use long"))

    def placed(self) -> DataFrame:
        """Documents with their place in their source's stream: doc_id, th,
        source_no, size, at (words of the source before the document).

        A source's documents are dealt by a hash into runs; the words before a
        run come from one row per run, those within a run from a window, so a
        large source spreads over tasks.
        """
        nos = common.small_table(self.spark, [(s, k, self.runs[k]) for k, s in enumerate(self.sources)] or [(None, 0, 1)],
                                 "name string, source_no long, runs long")
        docs = (self.sized.join(F.broadcast(nos), F.col("source").eqNullSafe(F.col("name")))
                .withColumn("run", F.pmod(F.xxhash64("doc_id", "th"), F.col("runs"))))
        runs = docs.groupBy("source_no", "run").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("source_no", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("run_at"))
        within = Window.partitionBy("source_no", "run").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
        return (docs.withColumn("in_run", F.coalesce(F.sum("size").over(within), F.lit(0)))
                .join(runs, ["source_no", "run"])
                .select("doc_id", "th", "source", "source_no", "size", (F.col("run_at") + F.col("in_run")).alias("at")))

    def block_pieces(self, placed: DataFrame) -> DataFrame:
        """(source_no, block, doc_id, th, at, lo, hi): the words lo..hi-1 of a
        document that lie in a block."""
        b = F.lit(self.block)
        cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(
            F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
        start = F.col("block") * b
        return cut.select("source_no", "block", "doc_id", "th", "at",
                          F.greatest(start - F.col("at"), F.lit(0)).alias("lo"),
                          F.least(start + b - F.col("at"), F.col("size")).alias("hi"))

    def taken_pieces(self, placed: DataFrame) -> DataFrame:
        """Blocks joined with slots by index: (shard, slot, source_no, epoch,
        doc_id, th, at, lo, hi), the words of documents that each slot takes."""
        # the slot table grows with the mix and the planner can't estimate it: never broadcast
        joined = self.block_pieces(placed).join(self.slot_table().hint("merge"), ["source_no", "block"])
        end = F.col("block") * F.lit(self.block) + F.col("use") - F.col("at")
        return (joined.withColumn("hi", F.least(F.col("hi"), end)).filter("hi > lo")
                .select("shard", "slot", "source_no", "epoch", "doc_id", "th", "at", "lo", "hi"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per row of the input."""
        placed = common.staged(self.placed(), "mix-placed")
        # sums per document; ``at`` tells equal documents of a source apart
        sums = self.taken_pieces(placed).groupBy("source_no", "doc_id", "th", "at").agg(
            F.sum(F.col("hi") - F.col("lo")).alias("words"))
        facts = common.small_table(
            self.spark, [(k, self.words[k], float(self.targets[k])) for k in range(len(self.words))] or [(0, 0, 0.0)],
            "source_no long, source_size long, target double")
        a, b = placed.alias("a"), sums.alias("b")
        return (a.join(b, (F.col("a.source_no") == F.col("b.source_no")) & (F.col("a.at") == F.col("b.at"))
                       & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
                       & (F.col("a.size") > 0), "left")
                .select("a.doc_id", "a.th", "a.source_no", "a.size", "a.at", F.coalesce("b.words", F.lit(0)).alias("taken"))
                .join(F.broadcast(facts), "source_no")
                .select("doc_id", "size", "source_size", "target", "taken"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: the columns doc_id, text, lang, source, n_chars of
    every row that gives words, ``text`` being the words it gives, pass after
    pass (a document taken twice has its text twice, a partly taken one only the
    taken words).  A document taken whole in a pass keeps its text unchanged in
    that pass; passes are joined by a line feed.
    """
    mix = Mix(docs, seed)
    placed = common.staged(mix.placed(), "mix-placed")
    spans = (mix.taken_pieces(placed).groupBy("source_no", "doc_id", "th", "at")
             .agg(F.collect_list(F.struct("epoch", "lo", "hi")).alias("spans")))   # bounded by the document's length
    # rows equal in id, source and text differ in ``at`` alone: they are numbered on both sides
    order = Window.partitionBy("doc_id", "source_no", "th").orderBy("at")
    p = (placed.filter("size > 0").withColumn("copy", F.row_number().over(order))).alias("p")
    s = spans.alias("s")
    spans = (p.join(s, (F.col("s.source_no") == F.col("p.source_no")) & (F.col("s.at") == F.col("p.at"))
                    & F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.th") == F.col("p.th")))
             .select(F.col("p.doc_id").alias("k_id"), F.col("p.th").alias("k_th"),
                     F.col("p.source").alias("k_source"), F.col("p.copy").alias("k_copy"), "s.spans"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        "lang", F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("th"))
    rows = rows.withColumn("copy", F.row_number().over(
        Window.partitionBy("doc_id", "source", "th").orderBy("lang")))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th"))
                       & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("copy") == F.col("k_copy")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for frame in frames:
            out = []
            for text, spans in zip(frame["text"], frame["spans"]):
                merged: list[list[int]] = []
                for s in sorted((int(s["epoch"]), int(s["lo"]), int(s["hi"])) for s in spans):
                    if merged and merged[-1][0] == s[0] and merged[-1][2] == s[1]:
                        merged[-1][2] = s[2]
                    else:
                        merged.append(list(s))
                at = [m.span() for m in word.finditer(text)]
                out.append("\n".join(text if (lo, hi) == (0, len(at)) else text[at[lo][0]:at[hi - 1][1]]
                                     for _, lo, hi in merged))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": out, "lang": frame["lang"],
                                "source": frame["source"], "n_chars": [len(t) for t in out]})

    return joined.select("doc_id", "text", "lang", "source", "spans").mapInPandas(
        common.released(run), "doc_id long, text string, lang string, source string, n_chars long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: doc_id, size, source_size, target, taken."""
    return Mix(common.table(spark, sf_dir, "documents")).taken()
