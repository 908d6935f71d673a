"""A corpus from raw documents to packed windows: five stages, each one operator of ``panelcast.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import catalog, jaccard, lines, packing, pii, quality
from panelcast.plans.lineage import new_path

#: Words whose ids a worker holds per generation: it goes on to hold them while other stages, or another run's, work beside it.
REMEMBERED = 100_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents_of(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` right for the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; rows that repeat a doc_id are judged one by one."""
    return documents_of(quality.judge(docs, into="_quality").where("_quality.kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sources; those that consisted of nothing else go."""
    done = lines.remove_boilerplate(docs, into="_removed")
    return documents_of(done.where((F.col("_removed") == 0) | F.coalesce(F.col("text").rlike(quality.WORD_IN_LINE), F.lit(False))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, and of several texts under that the one of
    least hash. Rows are told apart by doc_id and text, so an unrelated text under a doc_id stays; of equal rows one stays. Documents
    without doc_id or without words stay.
    """
    path = new_path(spark, "near-duplicates")
    jaccard.near_duplicates(docs, with_raw=True).withColumnRenamed("_raw", "mark").write.parquet(path)
    classes = spark.read.parquet(path).where(F.col("doc_id").isNotNull())
    linked = classes.where("n_links > 0")
    first = linked.where("kept").groupBy("doc_id").agg(F.min("mark").alias("first"))
    beside = linked.where("kept").join(first, "doc_id").where("mark > first").select("doc_id", "mark")
    gone = linked.where(~F.col("kept")).select("doc_id", "mark").unionByName(beside).distinct()
    marked = docs.withColumn("mark", F.xxhash64("text"))
    left = marked.join(gone, ["doc_id", "mark"], "left_anti")
    repeated = classes.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    if not repeated.isEmpty():
        once = left.join(repeated, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
        left = left.join(repeated, ["doc_id", "mark"], "left_anti").unionByName(once)
    return documents_of(left)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data under pseudonyms. Every row comes back; a null text stays null."""
    return documents_of(pii.pseudonymise(docs, catalog.PII_KEY, into="_found"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in windows of 2048 tokens. A null text counts as empty; an empty table has no pieces."""
    return packing.pack(docs, catalog.BYTE_BPE, with_ids=False, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packed),
]

#: Signatures, pseudonyms and token ids can't be had in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to ``documents``."""
    docs = catalog.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
