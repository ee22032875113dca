"""Token-id output as ORC: sorted stripes, integer run-length encoding, row
indexes and Bloom filters on the document id.

A document is one ORC row ``(doc_id, ids)``; the ids are encoded by ORC's
integer run-length encoding, every stripe carries row indexes, and the id
column has Bloom filters.  Files hold ascending, non-overlapping id ranges,
so a reader can prune files and stripes by metadata and read stripes in
parallel.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Written after the ids of every document.
END_ID = 1
#: ORC settings of the files.
STRIPE_BYTES = 16 * 1024 * 1024
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
#: Distinct words that a worker remembers before it forgets those not met since it last did.
WORD_MEMORY = 500_000
#: Bytes of text whose words are told apart together (a longer text alone).
SLICE_BYTES = 10_000_000

_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Whole-text ids from remembered ids of space-separated words.

    The tokenizer drops white space, never joins across it and always cuts between
    an ASCII letter and ASCII punctuation, so the ids of a text are those of its
    words in order, cut there (at spaces and line feeds only) and, as the tokenizer
    lower-cases, those of the lower-case word where it is ASCII.  Texts that may
    hold a special token (which the library matches before cutting words) are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        if len(self.memory) + len(words) > WORD_MEMORY:
            self.memory, self.older = {}, self.memory
        out = list(map(self.memory.get, words))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            known = self.older.get(words[i])
            if known is None:
                new.append(i)
            else:
                out[i] = self.memory[words[i]] = known
        # a word of ASCII small letters is one word to the tokenizer as it stands: to its model at once
        rest = []
        for i in new:
            w = words[i]
            if w.isascii() and w.isalpha() and w.islower():
                out[i] = self.memory[w] = array.array("I", [t.id for t in self.model.tokenize(w)]).tobytes()
            else:
                rest.append(i)
        for k in range(0, len(rest), 20_000):
            part = [words[i] for i in rest[k:k + 20_000]]
            for i, w, e in zip(rest[k:k + 20_000], part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                out[i] = self.memory[w] = array.array("I", e.ids).tobytes()
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end id last in each text; offsets of the texts) of texts
        without special tokens, from the ids of their distinct words."""
        flat = pc.replace_substring_regex(pc.fill_null(texts, ""), *_BEFORE_MARK)
        cut = pc.split_pattern(pc.replace_substring(flat, "\n", " "), " ")
        off = cut.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lower_ascii(cut.flatten()).dictionary_encode()
        raw = self.word_ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        # the ids of each distinct word, and the end id as one more word after each text's last
        flat = np.frombuffer(b"".join(raw) + END_ID.to_bytes(4, "little"), "<i4")
        of_word = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size), [len(flat)]])), pa.array(flat))
        word = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), off[1:] - off[0], len(size))
        taken = of_word.take(pa.array(word))
        ends = taken.offsets.to_numpy()[off - off[0] + np.arange(len(off))]
        return taken.flatten().to_numpy(zero_copy_only=False).view(np.uint32), ends - ends[0]

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = [*self.tok.encode(text, add_special_tokens=False).ids, END_ID]
        return np.array(ids, np.uint32), np.array([0, len(ids)])

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, offsets) for stretches of rows in order."""
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        stops = sorted({0, len(texts), *np.flatnonzero(odd), *(np.flatnonzero(odd) + 1)})
        for a, b in zip(stops[:-1], stops[1:]):
            if odd[a]:
                yield a, b, *self.whole(texts[a].as_py())
                continue
            for c, d in common.slices(lengths[a:b], SLICE_BYTES):
                yield a + c, a + d, *self.ids(texts.slice(a + c, d - c))


#: A place between an ASCII letter and ASCII punctuation, and the space put there.
_BEFORE_MARK = (r"([A-Za-z])([!-/:-@\[-`{-~])", r"\1 \2")


def lower_ascii(words: pa.Array) -> pa.Array:
    """ASCII words in lower case, others as they stand (their marks may combine)."""
    return pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)


def _encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) of several batches together, up to about a slice."""
    held, size = [], 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + n > SLICE_BYTES:
            yield _joined(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, end id included, rows in the
    order of ``docs``; a null or empty text has the end id alone."""
    common.prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for docs, texts in gathered(batches):
            for a, b, ids, off in enc.parts(texts):
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32)))],
                    names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def write_orc(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode every text and write ORC files whose rows ascend by doc_id (nulls
    first), over all files in name order.

    Rows are range-partitioned by id, ties by a hash of the text, so that an
    id repeated on many rows is split over files.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.withColumn("th", F.xxhash64("text"))
               .repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th"))
    (encode(ordered, tokenizer).write.format("orc")
     .option("compression", "zstd")
     .option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
     .option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
     .save(path))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of written files; filters on doc_id prune stripes."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written files: doc_id, start (ids of all documents
    before it in file order), n_tokens, ids_crc32.

    Rows are numbered as they stand in their file (a stripe range is read by one
    task, in order), so rows that share an id get the starts that are theirs.  The
    running sum is taken per file, so no task sees more than one file; the per-file
    totals (one row per file) are joined.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            lists = batch.column("ids")
            off = lists.offsets.to_numpy(zero_copy_only=False)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("block"),
                 pa.array(np.arange(seen, seen + len(crc))), pa.array(np.diff(off).astype(np.int64)),
                 pa.array(crc, pa.int64())], names=["doc_id", "part", "block", "k", "n_tokens", "ids_crc32"])
            seen += len(crc)

    rows = read_orc(spark, path).select(
        "doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"),
        F.col("_metadata.file_block_start").alias("block"), "ids")
    rows = common.staged(rows.mapInArrow(
        run, "doc_id long, part int, block long, k long, n_tokens long, ids_crc32 long"), "token-digest")
    # One row per file: its total and, by a window over those rows, what lies before it.
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    files = files.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("before"))
    within = Window.partitionBy("part").orderBy("block", "k").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("upto", F.sum("n_tokens").over(within)).join(files, "part")
            .select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"),
                    "n_tokens", "ids_crc32"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text in ORC files of ascending doc_id, read back
    as doc_id, start, n_tokens, ids_crc32 (null and empty texts: the end id)."""
    path = common.new_path(spark, "tokens.orc")
    write_orc(common.table(spark, sf_dir, "documents"), path)
    return digest(spark, path)
