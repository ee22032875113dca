"""Repeated passages of 400 bytes, exactly up to 64-bit hashes, by anchored window hashing.

This stands in the place of prefix-free parsing with suffix arrays: there is no
phrase dictionary, no parse, no suffix array of either and no order of suffixes: in
text that repeats little the dictionary is as large as the text (README has figures).
Only the triggers of prefix-free parsing are used: positions where a rolling hash
of ``WINDOW`` bytes is 0 modulo ``MODULUS``.  A trigger depends on its window
alone, so equal strings have equal triggers wherever they stand.  A text position
has the next trigger as its anchor.  Positions with equal 400-byte strings have
equal distances to their anchors, so windows around anchors are grouped by rolling
hashes (prefix sums of a polynomial, two of 64 bits), from coarse to fine:

1. For each anchor and each band of ``BAND`` start positions before it one row:
   the hash of the bytes that all the band's 400-byte strings share (``core``)
   and of all bytes that they cover (``span``).  Cores that occur once are
   dropped: their positions can't repeat.
2. A span that occurs again marks all its band's positions as repeated.
3. Where a core repeats but its spans differ, the band is resolved to single
   positions: one representative of each distinct span gives the hash of every
   400-byte string, and those that occur again are marked.

Positions whose 400-byte string has no trigger are single positions from the
start.  Rows grow with the text divided by the mean phrase length, and step 3
with the ends of repeats.  Grouping is by hash keys with map-side aggregation;
no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_passages
from .rolling import BASE, Hashes, signed

#: Fixed value of the task: bytes of a repeated string.
LENGTH = 400
#: Bytes of the rolling window, mean distance of triggers, start positions of a band.
WINDOW = 16
MODULUS = 64
BAND = 64
CORE = LENGTH - BAND + 1


def parse(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of step 1 for texts given as bytes and offsets: doc (index), lo, hi
    (first and last start position, in the text), core, span, n (occurrences in
    these texts: more than 1 where they hold a string several times)."""
    h = Hashes.of_bytes(data)
    size = len(data)
    first, end = off[:-1], off[1:]
    long_ = np.flatnonzero(end - first >= LENGTH)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "core", "span", "n")}
    if not len(long_):
        return empty
    at = np.arange(max(size - WINDOW + 1, 0))
    trig = np.flatnonzero(common.mix64(h.of(at, at + WINDOW, 0)) % np.uint64(MODULUS) == 0)
    doc = np.searchsorted(off, trig, side="right") - 1
    ok = trig + WINDOW <= end[doc]
    trig, doc = trig[ok], doc[ok]
    # the anchor's band of starts: after the trigger before it, at most LENGTH - WINDOW back, the string within the text
    before = np.concatenate([[-1], trig[:-1]]) if len(trig) else trig
    before = np.maximum(before, first[doc] - 1)
    lo = np.maximum(before + 1, trig - (LENGTH - WINDOW))
    hi = np.minimum(trig, end[doc] - LENGTH)
    out = {k: [] for k in empty}
    for c in range(-(-(LENGTH - WINDOW + 1) // BAND)):
        near, far = c * BAND, c * BAND + BAND - 1
        a, b = np.maximum(lo, trig - far), np.minimum(hi, trig - near)
        i = np.flatnonzero(a <= b)
        a, b, t = a[i], b[i], trig[i]
        core = h.of(t - near, t - near + CORE, 0)
        span = h.of(a, b + LENGTH, 1)
        shape = ((t - a) * 512 + (t - b)).astype(np.uint64)
        out["core"].append(common.mix64(core + np.uint64(c)))
        out["span"].append(common.mix64(span ^ (shape * np.uint64(BASE))))
        for k, v in (("doc", doc[i]), ("lo", a), ("hi", b), ("n", np.ones(len(i), np.int64))):
            out[k].append(v)
    # starts without a trigger in their string: before the band of an anchor, after the last anchor
    last = np.concatenate([trig, first[long_] - 1])        # a trigger or the text's beginning ...
    owner = np.concatenate([doc, long_])
    order = np.argsort(last, kind="stable")
    last, owner = last[order], owner[order]
    nxt = np.concatenate([last[1:], [size + LENGTH]])
    same = np.concatenate([owner[1:] == owner[:-1], [False]])
    to = np.where(same, nxt - (LENGTH - WINDOW) - 1, end[owner] - LENGTH)
    to = np.minimum(to, end[owner] - LENGTH)
    count = np.maximum(to - last, 0)
    count[end[owner] - first[owner] < LENGTH] = 0
    if count.any():
        k = np.repeat(np.arange(len(last)), count)
        i = last[k] + 1 + (np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count))
        one, two = h.of(i, i + LENGTH, 0), h.of(i, i + LENGTH, 1)
        new = np.ones(len(i), bool)                        # runs of equal strings at neighbouring positions are one row
        new[1:] = (i[1:] != i[:-1] + 1) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (k[1:] != k[:-1])
        s = np.flatnonzero(new)
        e = np.concatenate([s[1:], [len(i)]]) - 1
        out["core"].append(common.mix64(one[s] + np.uint64(1000)))
        out["span"].append(two[s])
        for name, v in (("doc", owner[k[s]]), ("lo", i[s]), ("hi", i[e]), ("n", e - s + 1)):
            out[name].append(v)
    rows = _merged({k: np.concatenate(v) for k, v in out.items()}, h)
    rows["lo"] = rows["lo"] - first[rows["doc"]]
    rows["hi"] = rows["hi"] - first[rows["doc"]]
    return rows


def _merged(rows: dict[str, np.ndarray], h: Hashes) -> dict[str, np.ndarray]:
    """Rows of one slice in which each (core, span) stands once, with its number
    of occurrences.  Positions that such a row stands for besides itself repeat
    within the slice; they are kept as ranges, neighbouring ones joined, with a
    key of their own and two occurrences."""
    order = np.lexsort((rows["lo"], rows["span"], rows["core"]))
    rows = {k: v[order] for k, v in rows.items()}
    new = np.ones(len(order), bool)
    new[1:] = (rows["core"][1:] != rows["core"][:-1]) | (rows["span"][1:] != rows["span"][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(new)]]))
    total = np.add.reduceat(rows["n"], at) if len(at) else rows["n"]
    known = np.repeat(size, size) > 1
    if not known.any():
        return rows
    doc, lo, hi = rows["doc"][known], rows["lo"][known], rows["hi"][known]
    rows = {k: v[at] for k, v in rows.items()}
    rows["n"] = total
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    top = np.maximum.accumulate(hi)                        # rows of a document don't overlap, documents follow each other
    cut = np.ones(len(lo), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1] + 1)
    s = np.flatnonzero(cut)
    e = np.concatenate([s[1:], [len(lo)]]) - 1
    lo, hi, doc = lo[s], top[e], doc[s]
    ranges = {"doc": doc, "lo": lo, "hi": hi, "n": np.full(len(s), 2),
              "core": common.mix64(h.of(lo, hi + LENGTH, 0) + np.uint64(2000)), "span": h.of(lo, hi + LENGTH, 1)}
    return {k: np.concatenate([v, ranges[k].astype(v.dtype)]) for k, v in rows.items()}


def anchors(docs: DataFrame) -> DataFrame:
    """Step 1 rows of (doc_id, th, text): core, span, n, doc_id, th, lo, hi."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.buffers(batch.column("text"))
            ids, th = batch.column("doc_id"), batch.column("th")
            for a, b in common.slices(np.diff(off)):
                r = parse(data[off[a]:off[b]], off[a:b + 1] - off[a])
                if not len(r["doc"]):
                    continue
                doc = pa.array(r["doc"] + a)
                yield pa.RecordBatch.from_arrays(
                    [signed(r["core"]), signed(r["span"]), pa.array(r["n"].astype(np.int64)), ids.take(doc), th.take(doc),
                     pa.array(r["lo"].astype(np.int32)), pa.array(r["hi"].astype(np.int32))],
                    names=["core", "span", "n", "doc_id", "th", "lo", "hi"])

    return docs.mapInArrow(run, "core long, span long, n long, doc_id long, th long, lo int, hi int")


def _resolved(parts: DataFrame) -> DataFrame:
    """Step 3: (doc_id, th, text, bands) to one row per start position of the
    bands: h1, h2 (hashes of its 400 bytes), doc_id, th, lo."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.buffers(batch.column("text"))
            ids, th = batch.column("doc_id"), batch.column("th")
            bands = batch.column("bands").to_pylist()
            for a, b in common.slices(np.diff(off)):
                h = Hashes.of_bytes(data[off[a]:off[b]])
                doc, at = [], []
                for k in range(a, b):
                    got = np.unique(np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in bands[k]]))
                    doc.append(np.full(len(got), k))
                    at.append(got)
                doc, at = np.concatenate(doc), np.concatenate(at)
                for s in range(0, len(at), 500_000):
                    d, i = doc[s:s + 500_000], at[s:s + 500_000]
                    lo = i + off[d] - off[a]
                    d = pa.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [signed(h.of(lo, lo + LENGTH, 0)), signed(h.of(lo, lo + LENGTH, 1)), ids.take(d), th.take(d),
                         pa.array(i.astype(np.int32))], names=["h1", "h2", "doc_id", "th", "lo"])

    return parts.mapInArrow(run, "h1 long, h2 long, doc_id long, th long, lo int")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi): ranges of start positions of repeated 400-byte
    strings, for (doc_id, th, text) rows; ranges may overlap."""
    rows = anchors(docs)
    cores = (rows.groupBy("core").agg(F.sum("n").alias("total"), F.min("span").alias("s0"), F.max("span").alias("s1"))
             .filter("total > 1").select("core", (F.col("s0") == F.col("s1")).alias("alike")))
    hits = common.staged(rows.join(cores, "core"), "suffix-hits", True)
    whole = hits.filter("alike").select("doc_id", "th", "lo", "hi")
    mixed = hits.filter("not alike")
    spans = common.staged(
        mixed.groupBy("core", "span").agg(F.sum("n").alias("total"),
                                          F.min(F.struct("doc_id", "th", "lo", "hi")).alias("one")), "suffix-spans", True)
    again = (mixed.join(spans.filter("total > 1").select("core", "span"), ["core", "span"])
             .select("doc_id", "th", "lo", "hi"))
    bands = (spans.select("one.*").distinct().groupBy("doc_id", "th")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("bands")))        # bounded by the text's length
    d, b = docs.alias("d"), bands.alias("b")
    places = _resolved(d.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.th") == F.col("b.th")))
                       .select("d.doc_id", "d.th", "d.text", "b.bands"))
    places = common.staged(places.dropDuplicates(["doc_id", "th", "lo"]), "suffix-places", True)
    twice = places.groupBy("h1", "h2").agg(F.count("*").alias("total")).filter("total > 1").select("h1", "h2")
    single = places.join(twice, ["h1", "h2"]).select("doc_id", "th", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(again).unionByName(single)


def removed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_bytes,
    n_removed, n_spans, kept (binary), n_passage_words (words within passages of over
    50 words that another row has too, whatever their bytes; they are told, not removed).

    Null texts are empty; texts of any length are handled whole, in slices of whole
    texts (a longer text is one slice); further columns are not read.  Repeated rows count as further occurrences, so rows
    equal to each other lose all text that is long enough.  Rows of one id with
    different texts are told apart by a hash of the text.
    """
    common.prepare(docs.sparkSession)
    docs = docs.select(*common.text_key())
    starts = repeated_starts(docs.filter(F.octet_length("text") >= LENGTH)).select("doc_id", "th", F.struct("lo", "hi").alias("range"))
    words = word_passages.passage_words(docs)
    ranges = (starts.unionByName(words, allowMissingColumns=True).groupBy("doc_id", "th")
              .agg(F.collect_list("range").alias("ranges"), F.max("n_words").alias("n_words")))      # bounded by the text's length
    d, r = docs.alias("d"), ranges.alias("r")
    joined = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.th") == F.col("r.th")), "left") \
        .select("d.doc_id", "d.text", "r.ranges", F.coalesce("r.n_words", F.lit(0)).alias("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.buffers(batch.column("text"))
            lists = batch.column("ranges")
            cut = lists.offsets.to_numpy(zero_copy_only=False)
            flat = lists.values
            lo_all = flat.field("lo").to_numpy(zero_copy_only=False)
            hi_all = flat.field("hi").to_numpy(zero_copy_only=False)
            out = []
            for k in range(len(off) - 1):
                text = data[off[k]:off[k + 1]]
                lo, hi = lo_all[cut[k]:cut[k + 1]].astype(np.int64), hi_all[cut[k]:cut[k + 1]].astype(np.int64)
                if not len(lo):
                    out.append((len(text), 0, 0, text.tobytes()))
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, hi + LENGTH, -1)
                gone = np.cumsum(step[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), runs, text[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)),
                 pa.array([o[3] for o in out], pa.binary()), batch.column("n_words")],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of repeated 400-byte strings:
    doc_id, n_bytes, n_removed, n_spans, kept_sha256, the remaining text (bytes that
    no longer make a character become the replacement character), and n_passage_words:
    the document's words within passages of over 50 words that another document has
    too.  Such passages may have fewer than 400 bytes, and then they stay in the text."""
    out = removed(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "n_passage_words")


def brute_force(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by listing every 400-byte string: for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - LENGTH + 1):
            seen[t[i:i + LENGTH]] = seen.get(t[i:i + LENGTH], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
