"""Near-duplicate vectors: every pair at the cosine threshold or above, none below, by tiles of vectors that meet each other.

Unit vectors at cosine c or more are at squared distance 2 - 2c or less. Vectors are put in the order of the cells of a fixed random
rotation, whose leading coordinates are split at their means, and cut into tiles. Each two tiles meet once, in one of the
tasks that read a part of the tiles each on both sides: the vectors are shuffled twice, to join equal ones and to order them, however many
tiles meet. Within two tiles a vector goes no further if it is too far from the ball around the other tile to be near any vector there;
the products of all others are taken in single precision.

Pairs near the threshold are verified on the original numbers in double precision. Pairs needn't be listed: tasks return the number of
links per vector and a forest of links. Equal vectors are joined to one before all this.

How much the balls prune depends on the data: vectors without structure meet all others, which takes n^2 / 2 products.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .components import components
from .jaccard import forest

#: Vectors per cell aimed at, vectors of a tile, and those of them that are multiplied with the other tile at a time.
PER_CELL, OWN_TILE, SENT_TILE = 2048, 4096, 1024
#: Bytes of the numbers of a tile, and of the tiles that a task writes.
TILE_BYTES, PART_BYTES = 1 << 20, 1 << 24


@lru_cache(maxsize=2)
def rotation(size: int, bits: int) -> np.ndarray:
    """Leading coordinates of a fixed random rotation."""
    square, corner = np.linalg.qr(np.random.default_rng(20240607).standard_normal((size, max(1, min(size, bits)))))
    return square * np.sign(np.diag(corner))


def cell_bits(vectors: int) -> int:
    """Coordinates that are split: cells of about ``PER_CELL`` vectors, at most 16 coordinates."""
    return max(0, min(16, round(np.log2(max(1, vectors) / PER_CELL))))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _stored(kind: str):
    """The numbers of each vector without the zeros at its end, or null if it links with nothing."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            # A null becomes not a number, and a zero below zero one above.
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
            stops = np.cumsum(lengths)
            starts = stops - lengths
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            last = np.concatenate([[0], np.maximum.accumulate(np.where(flat != 0, np.arange(1, len(flat) + 1), 0))])[stops] if len(flat) else stops
            usable = (bad[stops] == bad[starts]) & (last > starts) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            data, wide = flat.tobytes(), np.dtype(kind).itemsize
            rows = zip(usable.tolist(), (starts * wide).tolist(), (last * wide).tolist(), strict=True)
            numbers = [data[start:stop] if use else None for use, start, stop in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.binary())], ["id", "numbers"])

    return run, "id bigint, numbers binary"


def matrix(numbers, size: int, kind: str) -> np.ndarray:
    """Rows of one length; shorter ones are filled with zeros."""
    width = size * np.dtype(kind).itemsize
    return np.frombuffer(b"".join([row.ljust(width, b"\0") for row in numbers]), kind).reshape(-1, size)


def _sums(size: int, kind: str):
    """Sums of the unit vectors of a task."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                total += unit(matrix(batch.column(0).slice(start, 2048).to_pylist(), size, kind).astype(float)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run, "total binary"


def _cells(size: int, kind: str, mean: np.ndarray, bits: int):
    """The cell of each vector: on which side of the walls it lies."""
    names = ["rep", "mark", "copies", "numbers"]

    def run(batches):
        turn = rotation(size, bits)[:, :bits]
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                above = unit(matrix(part.column(3).to_pylist(), size, kind).astype(float)) @ turn > mean @ turn
                cells = (above.astype(np.int64) << np.arange(turn.shape[1] - 1, -1, -1)).sum(axis=1) if bits else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells), *part.columns], ["cell", *names])

    return run, "cell bigint, rep bigint, mark bigint, copies bigint, numbers binary"


def _tiles(size: int, kind: str, rows: int):
    """Tiles of so many vectors one after another: their names, copies and numbers."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, rows - count)
                held.append(part)
                count, start = count + part.num_rows, start + part.num_rows
                if count == rows:
                    yield table(held)
                    held, count = [], 0
        if held:
            yield table(held)

    def table(parts):
        whole = lambda name: np.concatenate([part.column(part.schema.get_field_index(name)).to_numpy() for part in parts])
        names = np.stack([whole("rep"), whole("mark")], axis=1)
        numbers = [matrix(part.column(part.schema.get_field_index("numbers")).to_pylist(), size, kind).tobytes() for part in parts]
        columns = [names.tobytes(), whole("copies").astype(np.int64).tobytes(), b"".join(numbers)]
        return pa.RecordBatch.from_arrays([pa.array([column], pa.binary()) for column in columns], ["names", "copies", "numbers"])

    return run, "names binary, copies binary, numbers binary"


def _linked(size: int, kind: str, threshold: float):
    """Links and a forest of links of the vectors of two tiles, or of a tile with itself."""
    schema = "name binary, other binary, links bigint"
    fields = ["tile", "names", "copies", "numbers", "tile_b", "names_b", "copies_b", "numbers_b"]

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(name)) for name in fields]
            for row in range(batch.num_rows):
                first, second = (tuple(column[row].as_py() for column in columns[side : side + 4]) for side in (0, 4))
                sides = [first] if first[0] == second[0] else [first, second]
                yield pa.RecordBatch.from_arrays(list(pair(sides)), ["name", "other", "links"])

    def pair(sides):
        names = np.frombuffer(b"".join(side[1] for side in sides), np.int64).reshape(-1, 2)
        weights = np.frombuffer(b"".join(side[2] for side in sides), np.int64)
        units = unit(np.frombuffer(b"".join(side[3] for side in sides), kind).reshape(-1, size).astype(np.float64))
        here = np.arange(len(sides[0][2]) // 8)
        there = np.arange(len(here), len(names)) if len(sides) > 1 else here
        if len(sides) > 1:
            here, there = near(units, here, there), near(units, there, here)
        small, links, heads = units.astype(np.float32), np.zeros(len(names)), np.arange(len(names))
        other = small[there].T
        for start in range(0, len(here), SENT_TILE):
            rows = here[start : start + SENT_TILE]
            close = small[rows] @ other >= threshold - 1e-3
            if len(sides) == 1:
                close &= rows[:, None] < there[None, :]
            a, b = np.nonzero(close)
            for part in range(0, len(a), 1 << 14):
                x, y = rows[a[part : part + (1 << 14)]], there[b[part : part + (1 << 14)]]
                keep = (units[x] * units[y]).sum(axis=1) >= threshold
                x, y = x[keep], y[keep]
                links += np.bincount(x, weights[y], len(names)) + np.bincount(y, weights[x], len(names))
                apart = np.unique(np.stack([heads[x], heads[y]])[:, heads[x] != heads[y]], axis=1)
                if apart.size:
                    heads = np.array(forest(len(names), *apart.tolist()), np.int64)[heads]
        met = np.flatnonzero(links > 0)
        # Names whose order as bytes is that of their numbers.
        ordered = (names.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
        text = lambda rows: pa.array([row.tobytes() for row in ordered[rows]], pa.binary())
        return text(met), text(heads[met]), pa.array(links[met].astype(np.int64))

    def near(units, rows, others):
        """The rows that can be near a vector of ``others``: not further from their ball than the threshold allows."""
        middle = units[others].mean(axis=0)
        radius = np.sqrt(((units[others] - middle) ** 2).sum(axis=1).max())
        return rows[np.sqrt(((units[rows] - middle) ** 2).sum(axis=1)) <= radius + np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6]

    return run, schema


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of ``df``.

    ``n_links`` counts the other rows at cosine ``threshold`` or above, ``component_id`` is the least key that links
    reach, and ``kept`` says that this is the row's own key. Cosines are in double precision.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. Shorter vectors are
    compared as if filled with zeros. Rows that repeat a key are rows of their own. A row whose key is null takes no
    part: no links, a null component, not kept. Other columns, such as labels, are not read.
    """
    spark = df.sparkSession
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = new_path(spark, label)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    wanted = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    source = df.select(F.col(key).cast("bigint").alias("id"), wanted.alias("vector")).mapInArrow(*_stored(kind))
    marks = {"mark": F.xxhash64("numbers"), "second": F.xxhash64(F.lit(1), F.col("numbers"))}
    classes = source.where(F.col("numbers").isNotNull()).groupBy("numbers").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.select("rep", F.xxhash64("numbers").alias("mark"), "copies", "numbers"), "vectors")
    count, width = classes.agg(F.count("*"), F.max(F.octet_length("numbers"))).first()
    if not count:
        return _answer(source.select("id", F.lit(None).cast("bigint").alias("component"), F.lit(0).cast("bigint").alias("links")), df, key)

    # Walls at the means of unit vectors.
    size = width // np.dtype(kind).itemsize
    mean = sum(np.frombuffer(row["total"]) for row in classes.select("numbers").mapInArrow(*_sums(size, kind)).collect()) / count
    rows = max(1, min(OWN_TILE, TILE_BYTES // width))
    parts = max(-(-count * width // PART_BYTES), min(8, -(-count // rows)))
    # Cells are cut where they have too many vectors for a part.
    ordered = classes.mapInArrow(*_cells(size, kind, mean, cell_bits(count))).repartitionByRange(parts, "cell", "mark", "rep").sortWithinPartitions("cell", "mark", "rep")
    tiles = written(ordered.mapInArrow(*_tiles(size, kind, rows)).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    others = tiles.withColumnsRenamed({name: f"{name}_b" for name in tiles.columns})
    # Each two tiles meet in one order, of which either is as likely.
    drawn = F.pmod(F.xxhash64(F.least("tile", "tile_b"), F.greatest("tile", "tile_b")), F.lit(2)) == 0
    pairs = tiles.join(others, (F.col("tile") == F.col("tile_b")) | ((F.col("tile") < F.col("tile_b")) == drawn))
    found = written(pairs.mapInArrow(*_linked(size, kind, threshold)), "vector-links")

    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    heads = components(found, "name", "other").select(F.col("node").alias("name"), "component")
    # The first half of a name is its class's least key, the other half the hash of the numbers.
    linked = links.join(heads, "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = linked.groupBy("component").agg(F.min("name").alias("least"))
    half = lambda name, start: F.conv(F.hex(F.substring(name, start, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    linked = linked.join(least, "component").select(
        half("name", 1).cast("bigint").alias("rep"), half("name", 9).cast("bigint").alias("mark"), half("least", 1).cast("bigint").alias("component"), "links"
    )
    # Rows find their class by two hashes of its numbers, which don't travel again; rows alone in a class that has no links need none.
    member = classes.select("rep", "copies", *[column.alias(name) for name, column in marks.items()]).join(linked, ["rep", "mark"], "left")
    member = member.where((F.col("copies") > 1) | F.col("links").isNotNull()).select(
        "mark", "second", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    # Written first, so that Spark can split the copies of one vector over tasks; rows without a usable vector meet nobody.
    member = written(member, "vector-classes")
    marked = source.where(F.col("numbers").isNotNull()).select("id", *[column.alias(name) for name, column in marks.items()])
    linked = marked.join(member, list(marks), "left").drop(*marks)
    apart = source.where(F.col("numbers").isNull()).select("id")
    return _answer(linked.unionByName(apart, allowMissingColumns=True), df, key)


def _answer(rows: DataFrame, df: DataFrame, key: str) -> DataFrame:
    out = rows.select(
        F.col("id").cast(df.schema[key].dataType).alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(False)))
