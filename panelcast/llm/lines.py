"""Removal of lines that stand on many sites: distinct sites per line by HyperLogLog sketches, exact near the threshold.

Every line is known by its hash. Sketches of its sites are built where its lines lie and merge by aggregation, so a
line on a third of all pages sends one sketch per task. Lines that the sketch puts clearly above the threshold are
boilerplate; those within its error of the threshold get an exact distinct count; a line with fewer occurrences than
the threshold asks for sites is neither. The first document that has a boilerplate line keeps it, all others lose it,
so nothing disappears from the corpus, also where whole documents are copied from site to site.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .quality import SPACE, named, numbered, once

#: Deviations of a sketch within which a line is counted exactly.
DEVIATIONS = 4


def spread_lines(df: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """(row, id, site, place, h, g): one row per line that is not blank; ``row`` tells rows of different key or text apart."""
    rows = df.select(
        F.col(key).alias("id"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), *_row(key, text), F.split(F.col(text), "\n").alias("lines")
    )
    lines = rows.select("r1", "r2", "id", "site", F.posexplode("lines").alias("place", "line")).withColumn("line", F.btrim("line", F.lit(SPACE)))
    # Two hashes: together they don't meet by chance.
    return lines.where(F.length("line") > 0).select("r1", "r2", "id", "site", "place", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def _row(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text)).alias("r1"), F.xxhash64(F.col(text), F.col(key), F.lit(1)).alias("r2")


def boilerplate(lines: DataFrame, min_sites: int, precision: int = 12) -> DataFrame:
    """(h, g, owner): lines on ``min_sites`` sites or more, with the least id among their documents (null if all are null)."""
    stats = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(precision)).alias("sketch"), F.min("id").alias("owner"))
    stats = stats.where(F.col("n") >= min_sites).select("h", "g", "owner", F.hll_sketch_estimate("sketch").alias("sites"))
    path = new_path(lines.sparkSession, "spread")
    margin = 1 + DEVIATIONS * 1.04 / math.sqrt(1 << precision) * min_sites
    stats.where(F.col("sites") >= min_sites - margin).write.parquet(path)
    stats = lines.sparkSession.read.parquet(path)
    near = stats.where(F.col("sites") <= min_sites + margin)
    counted = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").count()
    exact = near.join(counted.where(F.col("count") >= min_sites), ["h", "g"], "left_semi")
    return stats.where(F.col("sites") > min_sites + margin).unionByName(exact).select("h", "g", "owner")


def remove_boilerplate(
    df: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = 10, into: str = "n_removed", precision: int = 12
) -> DataFrame:
    """``df`` without boilerplate lines in ``text``, and the number of lines removed as ``into``.

    Lines end at line feeds and are compared without white space at their ends; blank lines are never removed. A line
    on ``min_sites`` distinct values of ``site`` or more (null counts as a site) stays once, at its first place in the
    document of least ``key`` that has it; documents that repeat this key keep it too. Null texts stay null, empty ones
    empty. All rows stay, those that lose every line with an empty text. A column already named ``into`` is replaced,
    every other column stays as it is.
    """
    original = [name for name in df.columns if name != into]
    spark = df.sparkSession
    path = new_path(spark, "lines")
    spread_lines(df, key, site, text).write.parquet(path)
    lines = spark.read.parquet(path)
    found = lines.join(boilerplate(lines, min_sites, precision), ["h", "g"])
    places = found.groupBy("r1", "r2", "h", "g").agg(
        F.collect_set("place").alias("places"), F.min("place").alias("first"), F.first(F.col("id").eqNullSafe(F.col("owner"))).alias("own")
    )
    lost = F.when(F.col("own"), F.array_remove("places", F.col("first"))).otherwise(F.col("places"))
    removed = places.select("r1", "r2", lost.alias("lost")).where(F.size("lost") > 0)
    removed = removed.groupBy("r1", "r2").agg(F.flatten(F.collect_list("lost")).alias("lost"))
    packed = df.select(*numbered(original), F.col(f"`{text}`").alias("text"), *_row(key, text))
    joined = packed.join(removed, ["r1", "r2"], "left").drop("r1", "r2")
    joined = once(joined, lines=F.when(F.col("lost").isNotNull(), F.split(F.col("text"), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(left, lambda place: F.get("lines", place)), "\n")
    new = F.when(F.col("lost").isNotNull(), kept).otherwise(F.col("text"))
    return joined.select(*named(original, **{text: new}), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias(into))


#: DuckDB SQL for the query: exact counts throughout.
ORACLE = r"""
WITH split AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
), lines AS (
    SELECT *, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM split
), spread AS (
    SELECT t, min(doc_id) AS owner FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce(source, '')) >= 10
), marked AS (
    SELECT doc_id, line, place, spread.t IS NOT NULL AND (doc_id <> owner OR row_number() OVER (PARTITION BY doc_id, lines.t ORDER BY place) > 1) AS lost
    FROM lines LEFT JOIN spread USING (t)
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '') AS text, count(*) FILTER (lost) AS n_removed
FROM marked GROUP BY doc_id
"""
