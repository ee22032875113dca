"""Token output: ids equal whole-text encoding; files read back with right offsets."""
import glob
import zlib

import numpy as np
from pyarrow import orc
from tokenizers import Tokenizer

from paylake.llm import common, token_output as T

CASES = ["", None, "Hello  World\n\n it's", "<|endoftext|> a", "x" * 50_000, "é café ΣΣ İx",
         "tab\tand nbsp em \x1c\x85 end", "日本語 テキスト 漢字", "a" * 3 + " " * 1000 + "b", "don't  we'll 12345 !!! ?",
         "It'S DON'T x'S\u0301 H\u0331 I\u0307 A\u0301.b,c(d)e a<\u0338 K\u212a.", "end. Next,Word;THIRD-part_four's"]


def rows(spark):
    return spark.createDataFrame(
        [(i, t, "x", 1) for i, t in enumerate(CASES)] + [(3, "again 3", "x", 1), (None, "null id", "x", 1), (3, "again 3", "y", 2)],
        "doc_id long, text string, ids string, start int")


def test_ids_equal_whole_text_encoding(spark):
    tok = Tokenizer.from_file(T.default_tokenizer())
    got = T.encode(rows(spark)).collect()
    by = {(r.doc_id, tuple(r.ids)) for r in got}
    for r in rows(spark).collect():
        want = tok.encode(r.text or "", add_special_tokens=False).ids + [T.END_ID]
        assert (r.doc_id, tuple(want)) in by
    assert len(got) == len(CASES) + 3


def test_files_round_trip_and_offsets(spark):
    path = common.new_path(spark, "t.orc")
    T.write_orc(rows(spark), path)
    back = T.read_orc(spark, path).collect()
    out = sorted(T.digest(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    assert len(out) == len(back) == len(CASES) + 3
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out)
    assert ids == [(r.doc_id is not None, r.doc_id or 0) for r in out]
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    assert sorted(crc(r.ids) for r in back) == sorted(r.ids_crc32 for r in out)
    plan = T.read_orc(spark, path).filter("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan


def test_starts_are_the_files_own(spark):
    """Rows that share an id: each start is that of its place in the file."""
    path = common.new_path(spark, "s.orc")
    texts = [f"text {i} " + "w " * (i % 7) for i in range(400)]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    T.write_orc(df, path)
    at, want = 0, []
    for f in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*.orc")):
        for r in orc.ORCFile(f).read().to_pylist():
            want.append((at, r["doc_id"], zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())))
            at += len(r["ids"])
    assert sorted((r.start, r.doc_id, r.ids_crc32) for r in T.digest(spark, path).collect()) == want


def test_files_have_stripes_row_index_and_bloom_filters(spark, monkeypatch):
    """Footers: several stripes, compressed streams; a reader skips stripes by the Bloom filter."""
    monkeypatch.setattr(T, "STRIPE_BYTES", 1 << 16)
    path = common.new_path(spark, "b.orc")
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 10_000)]
    rows_ = [(2 * i, " ".join(words[j] for j in rng.integers(0, 10_000, 4))) for i in range(50_000)]   # size is looked at every 5,000 rows
    T.write_orc(spark.createDataFrame(rows_, "doc_id long, text string"), path)
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*.orc"))
    assert max(orc.ORCFile(f).nstripes for f in files) > 1
    assert all(orc.ORCFile(f).compression == "ZSTD" and orc.ORCFile(f).row_index_stride == T.ROW_INDEX_STRIDE for f in files if orc.ORCFile(f).nrows)
    # odd ids lie within the files' ranges, so only the Bloom filters can rule them out
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(max(files, key=lambda f: orc.ORCFile(f).nrows)),
                                                     jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    kinds = set()
    rows_reader = reader.rows()
    for stripe in reader.getStripes():
        footer = rows_reader.readStripeFooter(stripe)
        kinds |= {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
        encodings = [str(e.getKind()) for e in footer.getColumnsList()]
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
    assert encodings[1] == "DIRECT_V2" and encodings[3] == "DIRECT_V2"      # integer run-length encoding of ids


def test_empty_table(spark):
    path = common.new_path(spark, "e.orc")
    T.write_orc(rows(spark).filter("false"), path)
    assert T.digest(spark, path).collect() == []
