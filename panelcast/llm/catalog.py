"""Queries of the operators in this package over the supplied tables, at the settings meant for use."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from . import bpe, idfiles, jaccard, lines, packing, passages, periods, pii, quality, toxicity, urls, vectors, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: The key of the pseudonyms in these queries. In use it is a secret of whoever runs them.
PII_KEY = "example key"

#: The rules of the URL query.
URL_RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


def op2_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 or above."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model that has not seen the held-out fifth of the labels."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels.where(toxicity.remainder(F.col("doc_id")) != 0), "toxic")
    scored = toxicity.score(documents, model, columns=["doc_id"])
    held_out = toxicity.remainder(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids with their index, and read back from the files."""
    path = new_path(spark, "ids")
    idfiles.write_ids(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return idfiles.read_ids(spark, path, with_ids=False)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced, and how much was replaced."""
    done = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, into="found")
    return done.select("doc_id", "text", F.size("found").cast("bigint").alias("n_replaced"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the quality rules."""
    judged = quality.judge(table(spark, sf_dir, "documents"), into="report")
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[f"report.{name}" for name in report])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, and its links: five words, similarity 0.8."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, with four fifths of their words in place."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on ten sources or more."""
    return lines.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of them made periodic first, and digests of the runs and of the words that stay."""
    made = periods.with_period(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    done = periods.collapse(made, into="found", digest=True).select("doc_id", "found.*")
    done = done.withColumn("best", periods.highest("runs")).withColumn("n_runs", F.size("runs").cast("bigint"))
    return done.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periods.listed("runs").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on their sixteen leading components, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs judged by the rules, and by trees that learnt from the URLs which the rules decide."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_embedding_dups": op2_embedding_dups,
        "op3_toxicity": op3_toxicity,
        "op4_id_files": op4_id_files,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_bpe": op6_bpe,
        "op7_quality": op7_quality,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_passages": op9_passages,
        "op10_line_spread": op10_line_spread,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_whitening": op12_whitening,
        "op13_url_filter": op13_url_filter,
    }


def oracles() -> dict[str, str]:
    return {"op7_quality": quality.ORACLE, "op10_line_spread": lines.ORACLE}
