"""Near-duplicate documents by word n-grams: MinHash banding, then exact Jaccard on full n-gram sets.

1. One pass over the texts gives each row a key of its words and ``bands`` hashes of ``rows`` MinHash values. Rows
   with equal words form a class at once; from there on only classes travel.
2. Classes meet by band hash. Only the hash and a number are shuffled, and groups are counted before anyone is
   brought together. Groups with the same members in several bands are visited once.
3. Members of a group are cut into tiles. A task gets the texts of two tiles, builds their n-gram sets and verifies
   exactly those pairs for which this band is the first that they share, so no pair is counted twice. It returns
   links per member and a forest of links, not pairs: output grows with members, not with their square.
4. Components of the forests are the groups of near duplicates.

The number of bands follows from the target recall at the threshold, see ``banding``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .components import components
from .words import mix, ngram_set

#: Members of a group that a task holds of each of its two tiles.
TILE = 1024
#: Words of all members of a tile.
TILE_WORDS = 1 << 20
#: N-grams of a document whose hashes are made at once.
CHUNK = 1 << 14


def banding(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` values at which a pair of similarity ``threshold`` meets with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


@lru_cache(maxsize=4)
def _factors(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band of the least values of an n-gram set under ``bands * rows`` hash functions."""
    factors = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), CHUNK):
        part = grams[start : start + CHUNK]
        for place in range(0, len(factors), 16):
            values = factors[place : place + 16, None] * part[None, :]
            np.minimum(least[place : place + 16], values.min(axis=1), out=least[place : place + 16])
    values = mix(least).reshape(bands, rows)
    total = np.arange(bands, dtype=np.uint64)
    for row in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + values[:, row])
    return total.view(np.int64)


def signed(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, raw, words_key, n_words, bands): one row per row of ``df`` (id, text, raw)."""

    def run(batches):
        for batch in batches:
            keys, counts, found = [], [], []
            for value in batch.column(2).cast(pa.binary()):
                words = (value.as_py() or b"").split()
                keys.append(xxhash.xxh128_digest(b" ".join(words)))
                counts.append(len(words))
                found.append(signature(ngram_set(words, size), bands, rows) if words else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["id", "raw", "words_key", "n_words", "bands"],
            )

    schema = "id bigint, raw bigint, words_key binary, n_words bigint, bands array<bigint>"
    return df.select("id", "raw", "text").mapInArrow(run, schema)


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: n-grams that both lists hold become columns of two 0/1 matrices."""
    shared = np.intersect1d(np.concatenate(sets_a), np.concatenate(sets_b))
    total = np.zeros((len(sets_a), len(sets_b)), np.float32)
    if not len(shared):
        return total
    sides = []
    for sets in (sets_a, sets_b):
        grams = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        places = np.minimum(np.searchsorted(shared, grams), len(shared) - 1)
        hit = shared[places] == grams
        sides.append((owners[hit], places[hit]))
    for start in range(0, len(shared), 4096):
        matrices = []
        for sets, (owners, places) in zip((sets_a, sets_b), sides, strict=True):
            matrix = np.zeros((len(sets), min(4096, len(shared) - start)), np.float32)
            pick = (places >= start) & (places < start + 4096)
            matrix[owners[pick], places[pick] - start] = 1
            matrices.append(matrix)
        total += matrices[0] @ matrices[1].T
    return total


def forest(count: int, left: list[int], right: list[int]) -> list[int]:
    """The least node of the tree of each node, after joining ``left[i]`` with ``right[i]`` for all i."""
    parent = list(range(count))

    def root(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for a, b in zip(left, right, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(node) for node in range(count)]


def _verify(size: int, threshold: float):
    """Links and a forest of one pair of tiles of one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        band, first, second = (int(group[name].iloc[0]) for name in ("band", "tile_a", "tile_b"))
        group = group.sort_values("class", kind="stable")
        names, tiles, weights = group["class"].to_numpy(), group["tile"].to_numpy(), group["copies"].to_numpy()
        signs = np.stack([np.asarray(sign) for sign in group["bands"]])
        a, b = np.flatnonzero(tiles == first), np.flatnonzero(tiles == second)
        # Due here: pairs that share this band and none before it.
        due = signs[a, band][:, None] == signs[b, band][None, :]
        for earlier in range(band):
            due &= signs[a, earlier][:, None] != signs[b, earlier][None, :]
        if first == second:
            due &= a[:, None] < b[None, :]
        left, right = due.any(axis=1), due.any(axis=0)
        if not left.any():
            return pd.DataFrame({"class": [], "other": [], "links": []})
        a, b, due = a[left], b[right], due[left][:, right]
        texts = group["text"].to_numpy()
        sets = {place: ngram_set(texts[place].encode().split(), size) for place in {*a.tolist(), *b.tolist()}}
        sets_a, sets_b = [sets[place] for place in a.tolist()], [sets[place] for place in b.tolist()]
        both = overlaps(sets_a, sets_b).astype(np.float64)
        union = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])[None, :] - both
        x, y = np.nonzero(due & (both >= threshold * union - 1e-9))  # whole numbers: the slack is for the threshold's rounding
        x, y = a[x], b[y]
        links = np.bincount(x, weights[y], len(names)) + np.bincount(y, weights[x], len(names))
        heads = np.array(forest(len(names), x.tolist(), y.tolist()))
        met = np.flatnonzero(links > 0)
        return pd.DataFrame({"class": names[met], "other": names[heads[met]], "links": links[met].astype("int64")})

    return run


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999,
    rows: int = 5, tile: int = TILE, tile_words: int = TILE_WORDS, with_raw: bool = False,
) -> DataFrame:
    """(key, class_id, n_links, n_copies, kept): one row per row of ``df``.

    ``class_id`` is the least key that is reachable by links; ``n_links`` counts the other rows at a Jaccard
    similarity of ``threshold`` or more (rows with the same words included), ``n_copies`` the rows with the same
    words, and ``kept`` says whether a row is the one of its class to keep: its key is the class id.

    Words are runs of characters other than space and U+0009 to U+000D. A text of fewer than ``size`` words has
    all of them as its one n-gram. Null texts and texts without words link with nothing, and a row whose key is null
    takes no part: its class is null, and it is kept. Rows that repeat a key count as rows of their own and are
    kept together. Pairs with similarity ``threshold`` are found with probability ``recall``, more similar ones
    with higher. With ``with_raw`` there is a first column ``_raw``, xxhash64 of the text, that tells apart rows which
    repeat a key with different texts. That two groups of a band have the same members is judged by their number, sum and
    exclusive or of 64-bit hashes. A group of n texts that share a band takes n^2 / 2 comparisons, dealt over tiles. ``tile`` and ``tile_words`` bound what a task holds; they don't change results.
    """
    spark, extra = df.sparkSession, []
    bands = banding(threshold, recall, rows)
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("raw"))

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = new_path(spark, label)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    signs = written(signed(source, size, bands, rows), "signatures")
    usable = (F.col("n_words") > 0) & F.col("id").isNotNull()
    grouped = signs.where(usable).groupBy(F.col("words_key").alias("class"), "bands")
    classes = written(
        grouped.agg(F.min(F.struct("id", "raw")).alias("first"), F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
        .select("class", "bands", F.col("first.id").alias("id"), F.col("first.raw").alias("raw"), "copies", "n_words"),
        "classes",
    )

    exploded = classes.select("class", "n_words", F.posexplode("bands").alias("band", "hash"))
    mark = F.xxhash64("class")
    groups = exploded.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("words"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("class", F.lit(1)), 24)).alias("s")
    )
    # The same members in another band are the same pairs.
    first = groups.where("n > 1").groupBy("n", "words", "x", "s").agg(F.min(F.struct("band", "hash")).alias("g")).select("n", "words", "g.*")
    tiles = F.greatest(F.ceil(F.col("n") / F.lit(tile)), F.ceil(F.col("words") / F.lit(tile_words))).alias("tiles")
    members = written(exploded.join(first.select("band", "hash", tiles), ["band", "hash"]).drop("n_words"), "members")

    wanted = members.select("class").distinct().join(classes, "class").select("id", "raw", "class", "copies", "bands")
    texts = source.join(wanted, ["id", "raw"]).select("class", "copies", "bands", "text").dropDuplicates(["class"])
    placed = members.withColumn("tile", F.pmod(F.xxhash64("class", F.lit(7)), F.col("tiles")))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("partner"))
    placed = placed.select("class", "band", "hash", "tile", F.least("tile", "partner").alias("tile_a"), F.greatest("tile", "partner").alias("tile_b"))
    pairs = placed.join(texts, "class").groupBy("band", "hash", "tile_a", "tile_b")
    found = written(pairs.applyInPandas(_verify(size, threshold), "class binary, other binary, links bigint"), "links")

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    heads = components(found, "class", "other").select(F.col("node").alias("class"), "component")
    member = classes.select("class", "id", "copies").join(links, "class", "left").join(heads, "class", "left")
    member = member.withColumn("component", F.coalesce("component", "class"))
    least = member.groupBy("component").agg(F.min("id").alias("class_id"))
    member = member.join(least, "component").select("class", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    # Written first, so that Spark can split the copies of one text over tasks; rows without a class meet nobody.
    member = written(member, "classes-linked")
    out = signs.where(usable).select("id", F.col("words_key").alias("class"), "raw").join(member, "class")
    apart = signs.where(~F.coalesce(usable, F.lit(False))).select("id", "raw")
    out = out.unionByName(apart, allowMissingColumns=True)
    if with_raw:
        extra = [F.col("raw").alias("_raw")]
    out = out.select(
        *extra,
        F.col("id").cast(df.schema[key].dataType).alias(key),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col(key), F.lit(True)))
