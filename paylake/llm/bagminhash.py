"""Near-duplicates by BagMinHash signatures over weighted five-word shingles.

A text is the multiset of its runs of five words (lower case, cut at white
space; a text of fewer words is one shingle); a shingle's weight is its count.
Similarity is the weighted Jaccard value: sum of minima over sum of maxima.

Signature (BagMinHash): weights are discretised into levels; each pair of
shingle and weight band (0,1], (1,2], (2,4], (4,8] ... carries a Poisson process
whose points, in order of time, have a level within the band and a component of
the signature, all from hashes of the shingle.  A point counts if its level is
not above the weight, so the bands below the weight count whole and the top one
is thinned; a component keeps the earliest point.  Points are made in rounds
and a process ends when it is later than the latest component, which needs
about one point per shingle for long texts.

Duplicates: texts with equal shingle multisets are one class representative.
Signatures are cut into ``BANDS`` bands of ``ROWS`` components; representatives
that share a band are candidates.  In each bucket the member that shares most buckets
with most others leads and is verified against every member (multiset overlap of the whole texts); verified
links give components.  Buckets that still hold several components get
``MORE_LEADERS`` further leaders one after the other.  Members that are then in
different components of a bucket are compared where their shingles allow a link:
with the shingles of all such members ordered from rare to frequent, two texts of
overlap 0.8 share one among the first of both (the weight before it is at most
the weight that the texts may not share), so they meet at that shingle.  The
filter is exact.  Large groups of copies cost a few comparisons per member, and
so do large groups of texts that are all a little less similar than 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: The most rounds of contraction, and of jumps within one.
MOST_ROUNDS = 60
#: Further leaders that buckets of several components get before pairs are listed.
MORE_LEADERS = 1

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(55).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_power = _inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        m = max(n, 1 << 20)
        inv = pow(_BASE, -1, 2**64)
        _power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, _BASE, np.uint64))])
        _inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, inv, np.uint64))])
    return _power, _inverse


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, shingle hash) of all shingles, in text order."""
    data, off = common.buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    solid = ~_BLANK[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    starts = off[:-1][np.diff(off) > 0]
    head[starts] = solid[starts]                                 # a text's first byte begins a word
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    stops = off[1:][np.diff(off) > 0] - 1
    tail[stops] = solid[stops]
    a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * power[:n])])
    word = common.mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    doc = np.searchsorted(off, a, side="right") - 1
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    # the shingle at each word; words too near the text's end start none
    k = np.arange(len(word)) - first[doc]
    runs = np.maximum(count[doc] - SHINGLE + 1, 1)
    at = np.flatnonzero(k < runs)
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        i = np.minimum(at + j, len(word) - 1)
        inside = (at + j < len(word)) & (k[at] + j < count[doc[at]])
        h += np.where(inside, word[i] * _MULT[j], np.uint64(0))
    return doc[at], common.mix64(h)


def multisets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc index, shingle hash, count), sorted by doc and hash."""
    doc, h = shingles(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """(n_docs, size) BagMinHash signatures (64-bit marks of the earliest points)
    of weighted sets; weights are positive reals.  Sets without elements get 0."""
    low, width = [], []
    item, level = [], 0
    lo, hi = 0.0, 1.0
    while True:                                                  # bands of weight that an element reaches
        i = np.flatnonzero(weight > lo)
        if not len(i):
            break
        item.append(i)
        low.append(np.full(len(i), lo))
        width.append(np.full(len(i), hi - lo))
        level += 1
        lo, hi = hi, hi * 2 if hi > 1 else 2.0
    if not item:
        return np.zeros((n_docs, size), np.uint64)
    item, low, width = np.concatenate(item), np.concatenate(low), np.concatenate(width)
    d, w = doc[item], weight[item].astype(float)
    seed = common.mix64(h[item] ^ common.mix64((low * 2).astype(np.uint64) + np.uint64(77)))
    best = np.full(n_docs * size, np.inf)
    mark = np.zeros(n_docs * size, np.uint64)
    late = np.full(n_docs, np.inf)
    time = np.zeros(len(d))
    step = 0
    while len(d):
        step += 1
        r = common.mix64(seed + np.uint64(step * _BASE % 2**64))
        time = time - np.log(_uniform(r)) / width
        go = time < late[d]
        if not go.all():
            d, w, low, width, seed, time, r = (x[go] for x in (d, w, low, width, seed, time, r))
            if not len(d):
                break
        r2 = common.mix64(r + np.uint64(0xD6E8FEB86659FD93))
        ok = low + _uniform(r2) * width <= w                     # thinning: the point's level is not above the weight
        slot = d * size + (common.mix64(r2) % np.uint64(size)).astype(np.int64)
        s, t, m = slot[ok], time[ok], r[ok]
        order = np.lexsort((t, s))
        s, t, m = s[order], t[order], m[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        s, t, m = s[first], t[first], m[first]
        less = t < best[s]
        best[s[less]], mark[s[less]] = t[less], m[less]
        touched = np.unique(d)
        late[touched] = best.reshape(n_docs, size)[touched].max(axis=1)
        go = time < late[d]
        d, w, low, width, seed, time = (x[go] for x in (d, w, low, width, seed, time))
    return mark.reshape(n_docs, size)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, th, set1, set2, bands) of (doc_id, th, text): two hashes of the
    shingle multiset and the hashes of the signature's bands (null for a text
    without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in common.slices(lengths):
                doc, h, n = multisets(texts.slice(a, b - a))
                sig = signatures(doc, h, n, b - a).reshape(b - a, BANDS, ROWS)
                band = np.zeros((b - a, BANDS), np.uint64)
                for j in range(ROWS):
                    band = common.mix64(band * np.uint64(_BASE) + sig[:, :, j])
                band = common.mix64(band + np.arange(1, BANDS + 1, dtype=np.uint64))
                has = np.bincount(doc, minlength=b - a) > 0
                sums = []
                for salt in (1, 2):
                    part = common.mix64((h ^ np.uint64(salt * 0x1234567)) + n.astype(np.uint64) * np.uint64(_BASE))
                    s = np.zeros(b - a, np.uint64)
                    np.add.at(s, doc, part)
                    sums.append(pa.array(s.view(np.int64), mask=~has))
                flat = pa.array(band.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), *sums,
                     pc.if_else(pa.array(has), lists, pa.scalar(None, lists.type))],
                    names=["doc_id", "th", "set1", "set2", "bands"])

    return docs.mapInArrow(common.released(run), "doc_id long, th long, set1 long, set2 long, bands array<long>")


def _texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with both texts."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a")


def overlaps(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with the exact overlap ``j`` of their multisets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (pc.binary_length(batch.column("text_a")).to_numpy(zero_copy_only=False)
                    + pc.binary_length(batch.column("text_b")).to_numpy(zero_copy_only=False))
            for x, y in common.slices(size):
                n = y - x
                both = pa.concat_arrays([batch.column("text_a").slice(x, n), batch.column("text_b").slice(x, n)])
                doc, h, count = multisets(both)
                pair = doc % n
                order = np.lexsort((h, pair))
                pair, h, count = pair[order], h[order], count[order].astype(float)
                twin = np.zeros(len(h), bool)
                twin[1:] = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
                at = np.flatnonzero(twin)
                common_ = np.bincount(pair[at], np.minimum(count[at], count[at - 1]), n)
                total = np.bincount(pair, count, n) - common_
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").slice(x, n), batch.column("b").slice(x, n), pa.array(common_ / np.maximum(total, 1))],
                    names=["a", "b", "j"])

    return _texts(texts, pairs).select("a", "b", "text_a", "text_b").mapInArrow(common.released(run), "a long, b long, j double")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is one node of the
    component.  Rounds of: each node points at its smallest neighbour or itself,
    pointers jump to their ends, and the links are contracted to links between
    ends.  A round leaves at most the nodes that no neighbour undercuts, so links
    and nodes shrink from round to round; every round is a written table, and only
    counts come to the driver."""
    edges = _between(links, name)
    labels = None
    for _ in range(MOST_ROUNDS):
        ways = edges.union(edges.select("b", "a"))
        ends = _ends(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("comp")), name)
        labels = ends if labels is None else common.staged(_renamed(labels, ends), f"{name}-labels")
        edges = _between(edges.join(ends.withColumnsRenamed({"node": "a", "comp": "a2"}), "a")
                         .join(ends.withColumnsRenamed({"node": "b", "comp": "b2"}), "b")
                         .select(F.col("a2").alias("a"), F.col("b2").alias("b")), name)
        if not edges.limit(1).count():
            return labels
    raise RuntimeError("contraction did not end")


def _between(links: DataFrame, name: str) -> DataFrame:
    """The distinct links (a, b) between different nodes, a below b; written."""
    return common.staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                         .filter("a < b").distinct(), f"{name}-edges")


def _ends(pointers: DataFrame, name: str) -> DataFrame:
    """Pointers (node, comp) followed to their ends, twice as far with each round."""
    for _ in range(MOST_ROUNDS):
        pointers = common.staged(pointers, f"{name}-pointers")
        far = pointers.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        if not pointers.join(far, "comp").filter("further <> comp").limit(1).count():
            return pointers
        pointers = pointers.join(far, "comp").select("node", F.col("further").alias("comp"))
    raise RuntimeError("pointers did not end")


def _renamed(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """Labels (node, comp) with each comp that has a new name under that name."""
    return (labels.join(ends.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left")
            .select("node", F.coalesce("root", "comp").alias("comp")))


def merged(comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``comps`` (node, comp) of all nodes after ``links`` between them: what was
    linked before stands for one node each, so only new links are followed."""
    a = comps.select(F.col("node").alias("a"), F.col("comp").alias("a2"))
    b = comps.select(F.col("node").alias("b"), F.col("comp").alias("b2"))
    fresh = links.select("a", "b").join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    return common.staged(_renamed(comps, components(fresh, name)), f"{name}-comps")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (bucket, rep, ...) with ``comp``, of buckets that hold several components."""
    placed = members.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("bucket")
    return placed.join(several, "bucket")


def elements(texts: DataFrame) -> DataFrame:
    """(rep, h, w, n): the distinct shingles of (rep, text), their counts, and the
    size of the multiset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("text")
            for x, y in common.slices(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False)):
                doc, h, w = multisets(t.slice(x, y - x))
                n = np.bincount(doc, w, y - x).astype(np.int64)
                rep = batch.column("rep").slice(x, y - x).to_numpy(zero_copy_only=False)
                for a in range(0, len(h), common.SLICE_BYTES // 32):
                    d = doc[a:a + common.SLICE_BYTES // 32]
                    b = a + len(d)
                    yield pa.RecordBatch.from_arrays([pa.array(rep[d]), pa.array(h[a:b].view(np.int64)), pa.array(w[a:b].astype(np.int64)), pa.array(n[d])],
                                                     names=["rep", "h", "w", "n"])

    return texts.select("rep", "text").mapInArrow(common.released(run), "rep long, h long, w long, n long")


def meeting(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members (rep, comp, buckets) of different components that
    share a bucket and may overlap by ``least``: a prefix filter over the texts'
    shingles, rare ones first.  No pair of that overlap that shares a bucket is lost."""
    every = common.staged(elements(texts.join(members.select("rep"), "rep")), "near-elements")
    # a shingle of one text only meets nothing, but its weight counts for the texts' order
    often = every.groupBy("h").agg(F.count("*").alias("df"))
    ranked = every.join(often, "h").withColumn(
        "before", F.sum("w").over(Window.partitionBy("rep").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w"))
    heads = ranked.filter((F.col("df") > 1) & (F.col("before") <= (1 - least) * F.col("n") + 1e-6)).select("rep", "h", "n", "before")
    heads = common.staged(heads.join(members, "rep"), "near-heads")
    x, y = heads.alias("x"), heads.alias("y")
    shared = (F.col("x.n") + F.col("y.n")) * (least / (1 + least)) - 1e-6            # the overlap that a link needs
    return (x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp"))
                   & (F.col("x.before") <= F.col("x.n") - shared) & (F.col("y.before") <= F.col("y.n") - shared)
                   & F.arrays_overlap("x.buckets", "y.buckets"))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, rep, comp, class_id): one row per row of ``docs`` (doc_id, text, ...).

    Rows are known by doc_id and a hash of the text.  ``rep`` is a number of the
    row's shingle multiset, ``comp`` of its class and ``class_id`` the smallest doc_id of all rows of
    its class (null ids come last; a class of null ids only has a null
    class_id, and classes that share an id may have the same one).  Texts without words (null, empty, blank) have no shingles and
    are each a class of their own: ``rep`` and ``comp`` are null and class_id is doc_id.
    """
    common.prepare(docs.sparkSession)
    docs = docs.select(*common.text_key())
    sk = common.staged(sketch(docs), "near-sketch")
    members = sk.filter("bands is not null")
    # one representative per shingle multiset, named by a hash of its two sums
    reps = common.staged(members.withColumn("rep", F.xxhash64("set1", "set2")).groupBy("rep")
                         .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("one"),
                              F.first("bands").alias("bands"), F.min("doc_id").alias("least_id")), "near-reps")
    bands = reps.select("rep", F.explode("bands").alias("bucket"))
    held = common.staged(bands.join(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket"), "near-held")
    # a text that others were made from shares more with each of them than they among themselves
    held = held.drop("n").join(held.groupBy("rep").agg(F.sum("n").alias("weight")), "rep")
    leaders = held.groupBy("bucket").agg(F.max_by("rep", F.struct("weight", "rep")).alias("leader"))
    shared = common.staged(held.join(leaders, "bucket"), "near-buckets")
    # texts of representatives that share a bucket with another one
    wanted = shared.select("rep").distinct().join(reps.select("rep", "one"), "rep") \
        .select("rep", F.col("one.doc_id").alias("w_id"), F.col("one.th").alias("w_th"))
    texts = common.staged(
        docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
        .select("rep", "text").dropDuplicates(["rep"]), "near-texts")
    near = f"j >= {least} - 1e-9"
    star = shared.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    found = common.staged(overlaps(texts, star), "near-overlaps")
    alone = common.staged(texts.select(F.col("rep").alias("node"), F.col("rep").alias("comp")), "near-alone")
    comps = merged(alone, found.filter(near), "near-star")
    # buckets that hold several components, with their leaders so far
    rest = common.staged(_open(shared.withColumn("leaders", F.array("leader")), comps), "near-open")
    for _ in range(MORE_LEADERS):
        if not rest.limit(1).count():
            break
        lead = (rest.filter(~F.array_contains("leaders", F.col("rep"))).groupBy("bucket")
                .agg(F.max_by("rep", F.struct("weight", "rep")).alias("lead")))
        led = rest.join(lead, "bucket")
        found = common.staged(overlaps(texts, led.filter("rep <> lead and not array_contains(leaders, rep)")
                                       .select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()), "near-overlaps")
        comps = merged(comps, found.filter(near), "near-led")
        rest = common.staged(_open(led.withColumn("leaders", F.array_append("leaders", F.col("lead"))).drop("lead"), comps), "near-open")
    # what is still in different components of a bucket; a representative is in one bucket a band at most
    rest = common.staged(rest.groupBy("rep").agg(F.first("comp").alias("comp"), F.collect_set("bucket").alias("buckets")), "near-open")
    more = meeting(rest, texts, least)
    found = common.staged(overlaps(texts, more), "near-overlaps")
    comps = merged(comps, found.filter(near), "near-all")
    named = (reps.select("rep", "least_id").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("comp", F.coalesce("comp", "rep")))
    classes = named.groupBy("comp").agg(F.min("least_id").alias("class_id"))
    named = named.join(classes, "comp").select("rep", "comp", "class_id")
    grouped = (members.select("doc_id", "th", F.xxhash64("set1", "set2").alias("rep")).join(named, "rep")
               .select("doc_id", "th", "rep", "comp", "class_id"))
    alone = sk.filter("bands is null").select("doc_id", "th", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("comp"),
                                              F.col("doc_id").alias("class_id"))
    return grouped.unionByName(alone)


def blank_rows(docs: DataFrame) -> DataFrame:
    """The rows whose text is null or has no word."""
    return docs.filter(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x09-\x0D\x20]"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: doc_id, class_id (its smallest
    doc_id), kept (whether the document is the one that stays)."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
