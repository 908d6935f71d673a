"""URLs judged by rules, and where no rule fits by boosted trees on lexical features, learnt from the URLs that rules decide.

A rule is a host and the beginning of a path. It fits the host and all its subdomains; of several that fit the longest wins.

Features of the others: lengths of URL, host and path, depth of host and path, shares of digits, letters and marks, entropy of the
characters, number and length of parameters, hyphens; and statistics of the host's suffixes (last label, last two
labels): how many URLs have the suffix, and how the labelled ones among them were judged. Suffixes are hashed into a fixed
number of buckets, so the table of statistics has a fixed size and is broadcast, whatever the number of hosts.
A labelled URL never sees its own host in them: hosts fall into folds, and statistics come from the other folds.

Trees are Spark ML's. They are fitted on at most about ``max_rows`` labelled URLs, taken by a hash of the URL; statistics are
those of all URLs, and every URL is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.lineage import new_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` in lower case without leading dot, ``path`` with its slash or empty, ``verdict`` allow or block."""

    host: str
    path: str
    verdict: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"A verdict is 'allow' or 'block', not {self.verdict!r}")
        if not self.host:
            raise ValueError("A rule needs a host")

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """``trees`` of ``depth``, fitted on about ``max_rows`` labelled URLs; suffixes in ``buckets``, hosts in ``folds``."""

    trees: int = 20
    depth: int = 4
    step: float = 0.2
    max_rows: int = 50_000
    buckets: int = 4096
    folds: int = 5
    seed: int = 42


def rest_of(url: Column) -> Column:
    """Host and path: what follows the first ``://`` up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.substring_index(F.substring_index(after, "?", 1), "#", 1)


def host_of(rest: Column) -> Column:
    return F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.substr(rest, F.length(F.substring_index(rest, "/", 1)) + 1)


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first in the list."""
    answer = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(sorted(rules, key=lambda rule: -len(rule.text))):
        under = (host == rule.host) | host.endswith("." + rule.host)
        fits = under & path.startswith(rule.path) if rule.path else under
        answer = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(answer)
    return answer


LEXICAL = [
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "letter_ratio",
    "entropy", "host_entropy", "parameters", "query_length", "hyphens", "longest_label",
]
STATISTICS = [f"{level}_{name}" for level in ("top", "domain") for name in ("share", "labelled", "blocked")]


def entropy(counts: np.ndarray) -> float:
    """Bits per byte."""
    total = counts.sum()
    if not total:
        return 0.0
    shares = counts[counts > 0] / total
    return float(-(shares * np.log2(shares)).sum())


def lexical(url: bytes, host: bytes, path: bytes) -> list[float]:
    """Numbers of a URL's characters; linear in its length."""
    counts = np.bincount(np.frombuffer(url, np.uint8), minlength=256)
    own = np.bincount(np.frombuffer(host, np.uint8), minlength=256)
    digits, letters = counts[48:58].sum(), counts[65:91].sum() + counts[97:123].sum()
    query = url.partition(b"#")[0].partition(b"?")[2]
    labels = host.split(b".") if host else []
    return [
        len(url), len(host), len(path), len(labels), sum(1 for part in path.split(b"/") if part),
        digits / max(len(url), 1), own[48:58].sum() / max(len(host), 1), letters / max(len(url), 1),
        entropy(counts), entropy(own), sum(1 for part in query.replace(b";", b"&").split(b"&") if part), len(query),
        int(own[45]), max(map(len, labels), default=0),
    ]


def with_lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path first) with the lexical features as columns behind its own."""
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in LEXICAL]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [[value.as_py() or b"" for value in batch.column(place).cast(pa.binary())] for place in range(3)]
            rows = np.array([lexical(*row) for row in zip(*given, strict=True)], np.float64).reshape(-1, len(LEXICAL))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(rows[:, place]) for place in range(len(LEXICAL))]], schema.names)

    return df.mapInArrow(run, schema)


def _bucket(host: Column, labels: int, settings: Settings) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -labels), F.lit(labels)), F.lit(settings.buckets)).cast("int")


def statistics(rows: DataFrame, level: str, urls: int) -> DataFrame:
    """Per bucket of a level: its share of all URLs, and how many labelled and blocked ones it has, in all and by fold."""
    bucket = f"{level}_bucket"
    count = F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")
    per_fold = rows.groupBy(bucket, "fold").agg(F.count(F.lit(1)).alias("n"), *count)
    folds = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("labelled", "blocked"))))
    return per_fold.groupBy(bucket).agg(
        (F.sum("n") / urls).alias(f"{level}_share"), F.sum("labelled").alias(f"{level}_all"), F.sum("blocked").alias(f"{level}_bad"), folds.alias(f"{level}_folds")
    )


def with_statistics(rows: DataFrame, tables: dict[str, DataFrame], prior: float) -> DataFrame:
    """``rows`` with the suffix statistics; those of a labelled row leave out its fold. Tables have at most ``buckets`` rows."""
    for level, table in tables.items():
        rows = rows.join(F.broadcast(table), f"{level}_bucket")
        own = F.when(F.col("label").isNotNull(), F.col(f"{level}_folds")[F.col("fold")])
        labelled = F.col(f"{level}_all") - F.coalesce(own["labelled"], F.lit(0))
        blocked = F.col(f"{level}_bad") - F.coalesce(own["blocked"], F.lit(0.0))
        share = (blocked + F.lit(2 * prior)) / (labelled + 2)
        rows = rows.withColumns({f"{level}_labelled": F.log1p(labelled.cast("double")), f"{level}_blocked": share})
    return rows


def judge(
    df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", settings: Settings = Settings(), label: str | None = None  # noqa: B008
) -> DataFrame:
    """(key, host, path, rule, verdict, score): one row per row of ``df``.

    ``rule`` is the text of the rule that decides, else null; ``verdict`` is its verdict, or the trees'. ``score`` is the
    trees' probability of block, null where a rule decides. The trees learn from the URLs that a rule decides and,
    if ``label`` names a column, from those where it is 1 (block) or 0 (allow); a rule comes before a label.

    Hosts and paths of a null URL, or one without ``://``, are empty; such a URL is judged by the trees. Labels of one kind only
    are the verdict of every other URL, with score 1 or 0; without any labels that is allow, with score 0. Null and repeated
    keys are rows like others; other columns are not read.
    """
    spark = df.sparkSession

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = new_path(spark, label)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    given = F.lit(None).cast("double") if label is None else F.when(F.col(f"`{label}`").isin(0, 1), F.col(f"`{label}`").cast("double"))
    rows = df.select(F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{key}`").alias("key"), given.alias("given"))
    rows = rows.withColumn("rest", rest_of(F.col("url"))).withColumns({"host": host_of(F.col("rest")), "path": path_of(F.col("rest"))})
    found = fitting(rules, F.col("host"), F.col("path"))
    rows = rows.select("url", "host", "path", "key", found.alias("found"), "given")
    rows = rows.withColumns(
        {
            "label": F.coalesce((F.col("found.verdict") == "block").cast("double"), "given"),
            "fold": F.pmod(F.xxhash64("host"), F.lit(settings.folds)).cast("int"),
            "top_bucket": _bucket(F.col("host"), 1, settings),
            "domain_bucket": _bucket(F.col("host"), 2, settings),
        }
    )
    rows = written(with_lexical(rows), "urls")
    counts = dict(rows.groupBy("label").count().collect())
    allowed, blocked, urls = counts.get(0.0, 0), counts.get(1.0, 0), sum(counts.values())
    decided = rows.where(F.col("found").isNotNull()).select("key", "host", "path", "found.rule", "found.verdict", F.lit(None).cast("double").alias("score"))
    rest = rows.where(F.col("found").isNull())
    if not allowed or not blocked:
        rest = rest.withColumn("score", F.lit(1.0 if blocked else 0.0))
    else:
        prior = blocked / (allowed + blocked)
        tables = {level: written(statistics(rows, level, urls), f"{level}-suffixes") for level in ("top", "domain")}
        features = VectorAssembler(inputCols=[*LEXICAL, *STATISTICS], outputCol="features")
        labelled = features.transform(with_statistics(_sample(rows, allowed, blocked, settings), tables, prior))
        labelled = written(labelled.select("features", "label", "weight"), "labelled-urls")
        trees = GBTClassifier(
            labelCol="label", weightCol="weight", maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, seed=settings.seed
        )
        scored = trees.fit(labelled).transform(features.transform(with_statistics(rest, tables, prior)))
        rest = scored.withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")).alias("verdict")
    rest = rest.select("key", "host", "path", F.lit(None).cast("string").alias("rule"), verdict, "score")
    return decided.unionByName(rest).withColumnRenamed("key", key)


def _sample(rows: DataFrame, allowed: int, blocked: int, settings: Settings) -> DataFrame:
    """At most about half of ``max_rows`` labelled URLs of each kind, by a hash of the URL, with weights that make up for the rest."""
    share = F.lit(1.0)
    for value, count in ((0.0, allowed), (1.0, blocked)):
        share = F.when(F.col("label") == value, F.lit(min(1.0, settings.max_rows / 2 / count))).otherwise(share)
    place = (F.xxhash64("url").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return rows.where(F.col("label").isNotNull()).withColumn("weight", 1 / share).where((place < share) | (share == 1.0))
