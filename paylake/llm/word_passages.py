"""Passages of over 50 words that stand in several documents, exactly up to 64-bit hashes.

Words are runs of other bytes than blanks (``[^\\x20\\x09-\\x0D]+``); what stands
between them doesn't matter.  A window of ``WORDS`` words is filed under the least
hash of its ``GRAM``-word strings (its core), so equal windows have equal cores
wherever they stand, and a core holds about 18 neighbouring windows:

1. For each run of neighbouring windows of one core one row: the core and the hash
   of all words that the run covers (``span``).  Cores of one document are dropped.
2. A span that stands in several documents marks all its windows.
3. Where documents share a core but not the span, the run is resolved to single
   windows: one run of each span of several documents and all others; windows of
   several documents are marked.

Grouping is by hash keys with map-side aggregation; no group is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .rolling import Hashes, signed

#: Words of a passage ("over 50 words"), words of the strings that windows are filed under.
WORDS = 51
GRAM = 17

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[Hashes, np.ndarray, np.ndarray]:
    """Texts given as bytes and offsets: hashes of word strings, the text of each
    word, each text's first word."""
    solid = ~_BLANK[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    start[off[:-1][full]] = solid[off[:-1][full]]          # words end where their text does
    end[off[1:][full] - 1] = solid[off[1:][full] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    word = Hashes.of_bytes(data, 1).of(start, end, 0)
    doc = np.searchsorted(off, start, side="right") - 1
    return Hashes([word, common.mix64(word + np.uint64(1))]), doc, np.searchsorted(doc, np.arange(len(off) - 1))


def parse(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of step 1: doc (index), lo, hi (first and last window, by its first word
    in the text), core, span, and whether the row is its document's first of the
    core (new_core) and of the span (new_span)."""
    h, doc, first = words(data, off)
    if len(doc) < WORDS:
        return {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "core", "span", "new_core", "new_span")}
    at = np.arange(len(doc) - GRAM + 1)
    least, width = h.of(at, at + GRAM, 0), 1
    wide = WORDS - GRAM + 1
    while width < wide:                                    # least hash of ``width`` neighbouring strings
        step = min(width, wide - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.flatnonzero(doc[:len(least)] == doc[WORDS - 1:])
    cut = np.ones(len(at), bool)                           # windows of neighbouring texts are no neighbours
    cut[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    s = np.flatnonzero(cut)
    lo, hi = at[s], at[np.concatenate([s[1:], [len(at)]]) - 1] if len(s) else at[s]
    text, core, span = doc[lo], least[lo], h.of(lo, hi + WORDS, 1)
    order = np.lexsort((span, core, text))
    new_core, new_span = np.ones(len(order), bool), np.ones(len(order), bool)
    same = (text[order][1:] == text[order][:-1]) & (core[order][1:] == core[order][:-1])
    new_core[order[1:]] = ~same
    new_span[order[1:]] = ~(same & (span[order][1:] == span[order][:-1]))
    return {"doc": text, "lo": lo - first[text], "hi": hi - first[text], "core": core, "span": span,
            "new_core": new_core, "new_span": new_span}


def runs(docs: DataFrame) -> DataFrame:
    """Step 1 rows of (doc_id, th, text)."""
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
                    [signed(r["core"]), signed(r["span"]), pa.array(r["new_core"].astype(np.int32)),
                     pa.array(r["new_span"].astype(np.int32)), ids.take(doc), th.take(doc),
                     pa.array(r["lo"].astype(np.int32)), pa.array(r["hi"].astype(np.int32))],
                    names=["core", "span", "new_core", "new_span", "doc_id", "th", "lo", "hi"])

    return docs.mapInArrow(run, "core long, span long, new_core int, new_span int, doc_id long, th long, lo int, hi int")


def _resolved(parts: DataFrame) -> DataFrame:
    """Step 3: (doc_id, th, text, runs) to one row per window of the runs: h1, h2
    (hashes of its words), doc_id, th, lo, several (its span is of several documents)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.buffers(batch.column("text"))
            ids, th, lists = batch.column("doc_id"), batch.column("th"), batch.column("runs")
            cut, flat = lists.offsets.to_numpy(), lists.values
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            several = flat.field("several").to_numpy(zero_copy_only=False)
            for a, b in common.slices(np.diff(off)):
                h, _, first = words(data[off[a]:off[b]], off[a:b + 1] - off[a])
                k = np.arange(cut[a], cut[b])
                doc = np.repeat(np.arange(a, b), np.diff(cut[a:b + 1]))
                size = hi[k] - lo[k] + 1
                k, doc = np.repeat(k, size), np.repeat(doc, size)
                at = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
                for s in range(0, len(at), 500_000):
                    i, d = at[s:s + 500_000], doc[s:s + 500_000]
                    x = i + first[d - a]
                    yield pa.RecordBatch.from_arrays(
                        [signed(h.of(x, x + WORDS, 0)), signed(h.of(x, x + WORDS, 1)), ids.take(pa.array(d)), th.take(pa.array(d)),
                         pa.array(i.astype(np.int32)), pa.array(several[k[s:s + 500_000]].astype(bool))],
                        names=["h1", "h2", "doc_id", "th", "lo", "several"])

    return parts.mapInArrow(run, "h1 long, h2 long, doc_id long, th long, lo int, several boolean")


def shared_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi): ranges of windows, by their first word, that also stand
    in another row of ``docs`` (doc_id, th, text); ranges may overlap.  Repeated
    rows are further documents."""
    rows = runs(docs)
    cores = (rows.groupBy("core").agg(F.sum("new_core").alias("docs"), F.min("span").alias("s0"), F.max("span").alias("s1"))
             .filter("docs > 1").select("core", (F.col("s0") == F.col("s1")).alias("alike")))
    hits = common.staged(rows.join(cores, "core").drop("new_core"), "passage-hits", True)
    whole = hits.filter("alike").select("doc_id", "th", "lo", "hi")
    mixed = hits.filter("not alike")
    spans = common.staged(
        mixed.groupBy("core", "span").agg((F.sum("new_span") > 1).alias("several"),
                                          F.min(F.struct("doc_id", "th", "lo", "hi")).alias("one")), "passage-spans", True)
    told = mixed.join(spans.select("core", "span", "several"), ["core", "span"]).select("doc_id", "th", "lo", "hi", "several")
    again = told.filter("several").drop("several")
    parts = (told.filter("not several").unionByName(spans.filter("several").select("one.*", "several")).groupBy("doc_id", "th")
             .agg(F.collect_list(F.struct("lo", "hi", "several")).alias("runs")))      # bounded by the text's length
    d, p = docs.alias("d"), parts.alias("p")
    places = common.staged(
        _resolved(d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.th") == F.col("p.th")))
                  .select("d.doc_id", "d.th", "d.text", "p.runs")), "passage-places", True)
    # a text that stands in two rows has spans of several documents, so different texts tell the others apart
    shared = (places.groupBy("h1", "h2").agg(F.max("several").alias("several"), F.min("th").alias("t0"), F.max("th").alias("t1"))
              .filter("several or t0 != t1").select("h1", "h2"))
    single = places.filter("not several").join(shared, ["h1", "h2"]).select("doc_id", "th", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(again).unionByName(single)


def passage_words(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_words): the words within shared windows of each text of ``docs``
    (doc_id, th, text) that has any.  Written in a job of its own: its shuffle files
    can go before the caller's begin."""
    ranges = shared_windows(docs.filter(F.octet_length("text") >= 2 * WORDS - 1))
    before = Window.partitionBy("doc_id", "th").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("hi") + WORDS - F.greatest(F.col("lo"), F.max(F.col("hi") + WORDS).over(before))       # beyond the ranges before
    return common.staged(ranges.withColumn("n", F.greatest(new, F.lit(0))).groupBy("doc_id", "th")
                         .agg(F.sum("n").alias("n_words")), "passage-words", True)


def brute_force(texts: list[bytes]) -> list[int]:
    """Words of each text within passages that other texts have too, by listing every window: for tests."""
    seen: dict[tuple, set[int]] = {}
    split = [t.split() for t in texts]                     # bytes.split() has the same blanks
    for k, ws in enumerate(split):
        for i in range(len(ws) - WORDS + 1):
            seen.setdefault(tuple(ws[i:i + WORDS]), set()).add(k)
    return [len({j for i in range(len(ws) - WORDS + 1) if len(seen[tuple(ws[i:i + WORDS])]) > 1 for j in range(i, i + WORDS)})
            for ws in split]
