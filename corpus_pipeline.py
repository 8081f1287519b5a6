"""A corpus pipeline: language ID, line dedup, near-dedup by shingle similarity, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads for the next. All but the
last return the columns of documents.

Defined results of every stage: null ids are ids like any other and rows with repeated ids are kept apart by their texts; further columns
of documents are not read; an empty table passes as an empty one. Null and empty texts have no language and leave in the first stage; a
stage that meets them anyway carries them through: the second and fourth unchanged, the third as one group, the last as their end id.
Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, packing, pii, simhash
from tidemark.llm.common import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5
WORDS = 5
SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a calibrated score of MIN_SCORE or more stay. Null and empty texts and those without a letter
    go; repeated rows are told alike."""
    model = langid.train(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    kept = langid.predict(docs.select(COLUMNS), model)
    return kept.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; a document that was nothing else goes. The first copy in the order of id (null first), text
    digest and line stays; repeated rows are cut alike; null and empty texts stay as they are."""
    cut = linededup.dedup_lines(docs.select(COLUMNS), min_words=linededup.MIN_WORDS)
    left = cut.where((F.col("removed_lines") == 0) | (F.col("removed_lines") < F.col("n_lines")))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similarities of SIMILAR percent or more link, one row stays: that of the smallest id (null ids last),
    then of the least text digest, then of the least other columns."""
    stage = Stage(spark, "near")
    named = F.struct("doc_id", F.md5("text").alias("text_md5"))
    groups = stage.write(simhash.similar_texts(docs.select("doc_id", "text"), words=WORDS, percent=SIMILAR).select("root", F.struct("doc_id", "text_md5").alias("row")))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("row.text_md5").alias("text_md5"))
    first = groups.groupBy("root").agg(F.min(order).alias("k")).select(F.struct("k.doc_id", "k.text_md5").alias("row"), F.lit(True).alias("stays"))
    times = groups.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    # only rows that go or that repeat others are told apart, so that the texts of all others need no shuffle where these are few
    odd = stage.write(times.join(first, "row", "left").where("stays is null or n > 1").select("row", F.coalesce("stays", F.lit(False)).alias("stays")))
    stage.drop(groups)
    rows = docs.select(named.alias("row"), *COLUMNS)  # structs match with null fields too
    single = rows.join(odd, "row", "left_anti").select(COLUMNS)
    repeated = rows.join(odd.where("stays"), "row", "left_semi").groupBy("row").agg(F.min(F.struct(*reversed(COLUMNS))).alias("one"))
    return single.unionByName(repeated.select(*[F.col(f"one.{c}") for c in COLUMNS]))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms. Every row stays, null and empty texts as they are; equal values get equal pseudonyms."""
    return pii.pseudonymise(docs.select(COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into training sequences. Each row is packed, a repeated one again; null and empty texts are their end id alone."""
    return packing.pack_documents(docs, packing.public_vocabulary())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("private", private), ("sequences", sequences)]
ORACLE_SQL = None  # language models and byte merges are not expressible in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir))
        if before is not None:
            stage.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
