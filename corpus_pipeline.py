"""The corpus pipeline: quality filter, near-duplicates, personal data, mix, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads back as the next
one's ``docs``.  All stages but the last return the columns of ``documents``.
Rows with a null id, null or empty texts, repeated rows and extra columns pass
through every stage with the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.llm import bagminhash, common, gumbel_pieces, mixing, pii_semicrf, quality_crf

COLUMNS = ("doc_id long", "text string", "lang string", "source string", "n_chars long")
NAMES = [c.split()[0] for c in COLUMNS]


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their types."""
    return docs.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores 0.3 or more; the others go."""
    docs = documents(docs)
    model = quality_crf.train(docs, common.table(spark, sf_dir, "labels"))
    return quality_crf.scored(docs, model, NAMES).filter(F.col("score") >= quality_crf.THRESHOLD).select(*NAMES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the smallest id
    (of rows with that id, the one with the smallest hash of the text; of rows without
    id, likewise).  Classes are told apart by their texts, not by ids, so an id on
    different texts joins no classes.  Texts without words stay."""
    docs = documents(docs).withColumn("th", F.xxhash64("text"))
    classes = bagminhash.near_duplicates(docs).filter("rep is not null")
    # the row that stays, by class: map-side minima of small keys
    stay = (classes.groupBy("comp")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("one"))
            .select(F.col("one.doc_id").alias("k_id"), F.col("one.th").alias("k_th")))
    blank = (bagminhash.blank_rows(docs).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct()
             .withColumn("blank", F.lit(True)))
    keys = stay.withColumn("blank", F.lit(False)).unionByName(blank)
    kept = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")))
    whole = kept.filter("blank").select(*NAMES)
    # rows repeated with the same id and text: one stays
    one = (kept.filter("not blank").groupBy("doc_id", "th")
           .agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("r"))
           .select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))
    return whole.unionByName(one).select(*NAMES)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind in angle brackets."""
    docs = documents(docs)
    out = pii_semicrf.detect(docs, pii_semicrf.train(docs), [n for n in NAMES if n != "text"] + ["text"])
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.col("redacted")).alias("text"), "lang", "source",
                      F.when(F.col("text").isNotNull(), F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with the words taken as text."""
    return mixing.mix_documents(documents(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every document: doc_id, draw, ids, log_prob,
    inclusion, and whether the ids decode to the text."""
    out = gumbel_pieces.sample(documents(docs), decoded=True)
    return out.select("doc_id", "draw", "ids", "log_prob", "inclusion", gumbel_pieces.round_trip().alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mix", mix), ("token_ids", token_ids)]

#: Trained models, sampled draws: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read back."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
