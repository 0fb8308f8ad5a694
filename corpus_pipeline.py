"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; the driver of a stage writes its result before the next reads
it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm import decontaminate, language, mixing, neardup, suffixdedup
from tidyfold.llm.common import BATCH_BYTES, bound_buffers, sent, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, have no language and go."""
    bound_buffers(spark, 1000, 4 << 20)
    model = language.train(language.labelled(docs), language.model_path())
    found = language.predict(docs.drop("lang_pred", "score"), model)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns) if model is not None else docs.filter(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` but those whose doc_id is among `ids` (one column, distinct)."""
    gone = sent(ids.select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, and one row of each id; rows without an id stay."""
    bound_buffers(spark, 1000, BATCH_BYTES)
    found = written(neardup.near_duplicates(docs.select("doc_id", "text")))
    kept = without(docs, found.filter(~F.col("kept")).select("doc_id").distinct())
    repeated = written(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    others = [c for c in docs.columns if c != "doc_id"]
    some = kept.join(sent(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_row")).select("doc_id", "_row.*")
    return without(kept, repeated).unionByName(some.select(*docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that repeat from documents of smaller ids. A character that a cut goes through goes whole."""
    bound_buffers(spark, 1000, BATCH_BYTES)
    found = suffixdedup.remove_repeats(docs, as_text=True)
    text = F.col("kept")
    columns = [text.alias("text") if c == "text" else F.length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col("others")[c].alias(c) for c in docs.columns]
    return found.select(*columns)


def row_key() -> Column:
    """A row by its id and its text's digest: an id may be missing, or stand on several texts."""
    return F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go; others of the same id, or without an id, stay."""
    leaks = decontaminate.contained(docs.select(row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = sent(written(leaks.select(F.col("doc_id").alias("_gone")).distinct()))
    return docs.join(gone, row_key() == F.col("_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: one row per document and copy that the mix takes, with the copy's number."""
    named = docs.withColumn("_key", row_key())
    found = mixing.mix_sources(named.select(F.col("_key").alias("doc_id"), "text", "source"))
    copies = found.groupBy("doc_id").agg(F.sum("copies").alias("_n")).filter("_n > 0").withColumnRenamed("doc_id", "_key")
    corpus = named.dropDuplicates(["_key"]).join(copies, "_key")
    return corpus.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("copy"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
]

#: Language ID has no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
