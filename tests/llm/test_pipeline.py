"""The corpus pipeline whole, with odd rows, and its stages on an empty table."""
import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_run_with_odd_rows(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.filter("doc_id is not null").orderBy("doc_id").limit(1)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "web", 0), (10**6 + 1, None, None, "web", None),
                                 (None, "a text without an id " * 30, "en", None, 3)], docs.select(*P.NAMES).schema)
    root = f"{tmp_dir}/odd"
    (docs.select(*P.NAMES).unionByName(odd).unionByName(one.select(*P.NAMES))
     .selectExpr("*", "1 as th", "'x' as class_id", "2 as rep").write.parquet(f"{root}/documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    out = P.run(spark, root).collect()
    known = {r.doc_id for r in docs.select("doc_id").collect()} | {None, 10**6, 10**6 + 1}
    assert out and {r.doc_id for r in out} <= known
    assert all(r.round_trip and 0 <= r.inclusion <= 1 for r in out)
    draws = {}
    for r in out:
        draws.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert all(len(set(v)) == len(v) <= 2 for k, v in draws.items() if k is not None and k < 10**6)


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for name, stage in P.STAGES:
        out = stage(spark, empty, SF)
        assert out.collect() == [], name
        if name != P.STAGES[-1][0]:
            assert out.columns == P.NAMES


def test_near_duplicates_by_class_not_by_id(spark):
    words = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11)) + str(i) for i in range(400)]
    a, b, c = (" ".join(words[i:i + 100]) for i in (0, 100, 200))
    edited = [c[:-len(words[299])] + w for w in ("end", "stop", "last")]            # near copies of c
    rows = [(7, a), (7, b), (8, a), (9, b), (None, c), *((None, t) for t in edited), (None, c), (None, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], ", ".join(P.COLUMNS))
    out = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(7, a), (7, b), (7, None), (None, ""), next(x for x in out if x[1] in (c, *edited))], key=str)
