"""The corpus pipeline: quality rules, language ID, line dedup, near-duplicate removal, packing.

STAGES: (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns the documents that stay, with the
columns of `documents`; the last returns packed pieces. Each stage's rows are written as Parquet and read again as the
next one's docs.

Rows with a NULL doc_id have no text to be joined by: quality rules and languages judge them like others, line dedup
leaves their lines alone, and of near duplicates one per exact text stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import langid, lines, neardup, packing, quality
from voltide.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5

#: Language ID trains a model; no SQL states the rows of run().
ORACLE_SQL = None


def _traces(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("series_id"), F.col("text").alias("trace"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The verdict is computed on the row itself."""
    rows = docs.select(F.struct(*COLUMNS).alias("series_id"), F.col("text").alias("trace"))
    return quality.quality_rules(rows).where("kept").select(*[F.col("series_id")[c].alias(c) for c in COLUMNS])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a score of at least LEAST_LANGUAGE_SCORE. Documents of two folds of three
    by id are learned from; where no document has a language, nothing can be found and all go."""
    others = [c for c in COLUMNS if c != "text"]
    rows = docs.select(F.struct(*others).alias("text_id"), "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))
    found = langid.identify_languages(rows, docs.where(fold != 1), with_text=True)
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*[F.col("text") if c == "text" else F.col("text_id")[c].alias(c) for c in COLUMNS])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that later ones have too; those of which nothing but white space stays go."""
    d = lines.dedup_lines(docs.select(F.col("doc_id").alias("series_id"), F.col("text").alias("trace"), "lang", "source"))
    d = d.where(F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return d.select(F.col("series_id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id, and of several with that id the one
    whose text has the least hash. Rows of one id with different texts are told apart by that hash; of rows equal in
    both, one with the least other columns stays."""
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_hash", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    classes = neardup.near_classes(named.select(F.struct("doc_id", "_hash").alias("series_id"), F.col("text").alias("trace")))
    keep = classes.where(F.col("series_id") == F.col("class_id")).select("class_id.doc_id", "class_id._hash").distinct()
    stay = named.join(keep, ["doc_id", "_hash"], "left_semi")
    stay = stay.groupBy("doc_id", "_hash").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return stay.unionByName(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]).select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(packing.token_pieces(_traces(docs))).withColumnRenamed("series_id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
