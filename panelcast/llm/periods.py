"""Periodic runs of words: stretches that repeat with a smallest period at least three times over.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of length
``max(least, 3 * q)`` or more, that no neighbouring word extends keeping the period.

1. Tiles: for every octave of periods [G, 2G), of which the first takes in all smaller ones, a document has an anchor every
   G words. The words of a run that equal the word q further on are 2G or more in a row, so they hold an anchor whose G words
   all equal those q further on. One pass of window hashes finds those anchors; where there are any, the words around
   them become tiles, rows of their own. Tiles of an octave overlap by as much as its periods reach.
2. Solving: each tile stands alone, in whatever task it lands. Z-functions of the words from an anchor on, and of those
   before it read backwards, give for all periods of the octave at once how far the equality reaches on both sides.
   An anchor whose next q words already have a period that divides q belongs to that smaller period.
3. Stitching: the intervals of a tile are merged, travel to their (document, period), and are merged there.

A document whose octaves have no such anchor, which is most of them, is answered in the first pass and its text goes
nowhere. The others' texts travel once, to meet their runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .words import mix

#: Words of a tile between its first and last anchor, at least; longer octaves have one anchor a tile.
TILE = 4096
#: Words of tiles that a task solves.
TASK_WORDS = 200_000
#: Bytes of text whose words are looked at together; a longer text is looked at alone.
SLICE = 4_000_000

WORD = "[^\\x20\\x09-\\x0D]+"

RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"

_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Numbers(dict):
    """Word -> number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; equal words, equal hashes."""
    count = len(ids)
    powers = np.full(count + 1, _ODD, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers[:count], out=sums[1:])
    back = np.full(count + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    ends = count - size + 1
    return (sums[size:] - sums[:ends]) * back[:ends]


def first_octave(least: int) -> int:
    """The widest distance of anchors at which every run of ``least`` words and smaller period still holds an anchor's words twice."""
    return max(1, (least + 2) // 3)


def anchors(ids: np.ndarray, size: int, first: bool) -> np.ndarray:
    """Places, multiples of ``size``, whose ``size`` words return at a distance of the octave: [size, 2 * size), from 1 on in the ``first``."""
    if len(ids) <= size:
        return np.empty(0, np.int64)
    found = windows(ids, size)
    rows = -(-len(found) // size)
    grid = np.zeros(rows * size, np.uint64)
    grid[: len(found)] = found
    grid = grid.reshape(rows, size)
    inside = np.arange(size) < len(found) - (rows - 1) * size
    again = grid[1:] == grid[:-1, :1]
    again[-1:] &= inside
    hit = np.append(again.any(axis=1), False)
    if first:
        again = grid == grid[:, :1]
        again[-1:] &= inside
        hit |= again[:, 1:].any(axis=1)
    return np.flatnonzero(hit) * size


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_factors(number: int) -> list[int]:
    found, divisor = [], 2
    while divisor * divisor <= number:
        if number % divisor == 0:
            found.append(divisor)
            while number % divisor == 0:
                number //= divisor
        divisor += 1
    return found + [number] * (number > 1)


def solve(words: list[int], places: list[int], size: int, first: bool) -> list[tuple[int, int, int]]:
    """(period, start, stop): places whose word returns a period later, merged over the anchors of a tile.

    From each anchor the equality is followed for ``2 * size`` words ahead and ``size`` back; the next anchor goes on.
    """
    low = 1 if first else size
    found: dict[int, list[list[int]]] = {}
    for at in places:
        ahead = z_function(words[at : at + 4 * size])
        periods = [q for q in range(low, min(2 * size, len(ahead))) if ahead[q] >= size]
        periods = [q for q in periods if not any(ahead[q // p] >= q - q // p for p in prime_factors(q))]
        if not periods:
            continue
        before, text = words[max(at - size, 0) : at][::-1], words[max(at - size, 0) : at + 2 * size][::-1]
        back = z_function([*before, -1, *text])
        ends = len(back) - len(text) + len(words[at : at + 2 * size])  # the word before at + q stands q before this place
        for q in periods:
            start, stop = at - back[ends - q], at + min(ahead[q], 2 * size)
            spans = found.setdefault(q, [])
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([start, stop])
    return [(q, start, stop) for q, spans in found.items() for start, stop in spans]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run (start, length, period) holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([word for word, kept in zip(words, keep.tolist(), strict=True) if kept])


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for place, text in enumerate(texts):
        if place > start and total + len(text) > SLICE:
            yield start, place
            start = place
            total = 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


_TILE = "row bigint, words bigint, collapsed string, text string, size int, start bigint, ids array<int>, places array<int>"
_NAMES = [field.split()[0] for field in _TILE.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _look(least: int, finish):
    """One row per text, finished if it has no tiles, with its words otherwise; and one row per tile."""
    first = first_octave(least)

    def tiles_of(numbers: list[int], lists: list[list[bytes]]) -> Iterator[tuple]:
        known = Numbers()
        ids = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in lists]
        counts = np.array([len(words) for words in lists])
        size = first
        while max(least, 3 * size) <= counts.max(initial=0):
            members = np.flatnonzero(counts >= max(least, 3 * size))
            # A number of its own after each text keeps windows from running on into the next.
            stream = np.concatenate([part for place in members.tolist() for part in (ids[place], [len(known) + place])])
            begins = np.cumsum(counts[members] + 1) - counts[members] - 1
            found = anchors(stream, size, size == first)
            owner = np.searchsorted(begins, found, "right") - 1
            tile = found // size // max(1, TILE // size)
            cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(tile) != 0)) + 1
            for some in np.split(np.arange(len(found)), cuts) if len(found) else ():
                place = int(members[owner[some[0]]])
                places = found[some] - begins[owner[some[0]]]
                start = max(int(places[0]) - size, 0)
                yield place, (numbers[place], None, None, None, size, start, ids[place][start : int(places[-1]) + 4 * size], (places - start).astype(np.int32))
            size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, kept = batch.column(0).to_pylist(), batch.column(2)
            texts = [value.as_py() or b"" for value in batch.column(1).cast(pa.binary())]
            for start, stop in _slices(texts):
                lists, has = [text.split() for text in texts[start:stop]], set()
                for tiles in _some(tiles_of(numbers[start:stop], lists)):
                    has |= {place for place, _ in tiles}
                    yield _batch([tile for _, tile in tiles], pa.nulls(len(tiles), kept.type))
                rows = []
                for place, words in enumerate(lists):
                    joined = b" ".join(words)
                    whole = (None, joined.decode()) if place in has else (finish(joined), None)
                    rows.append((numbers[start + place], len(words), *whole, None, None, None, None))
                yield _batch(rows, kept.slice(start, stop - start))

    return run


def _some(tiles: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Tiles in groups of bounded size."""
    held, weight = [], 0
    for tile in tiles:
        held.append(tile)
        weight += 16 + len(tile[1][6])
        if weight > 1 << 21:
            yield held
            held, weight = [], 0
    if held:
        yield held


def _batch(rows: list[tuple], kept: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, kept], [*_NAMES, "kept"])


def _solved(first: int):
    """row, period, start, stop of all intervals of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            rows, sizes, starts = (batch.column(i).to_pylist() for i in range(3))
            for row, size, start, ids, places in zip(rows, sizes, starts, batch.column(3), batch.column(4), strict=True):
                spans = solve(ids.values.to_pylist(), places.values.to_pylist(), size, size == first)
                found += [(row, q, start + a, start + b) for q, a, b in spans]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["row", "period", "start", "stop"])

    return run


def stitched(parts: DataFrame, least: int) -> DataFrame:
    """Runs (row, start, length, period) from intervals that overlap or touch within (row, period)."""
    before = Window.partitionBy("row", "period").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "period").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    islands = parts.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(upto))
    merged = islands.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return merged.select("row", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(least), 3 * F.col("period")))


def _collapsed(finish):
    """row and the collapsed words of texts with their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).cast(pa.binary()), []
            for text, runs in zip(texts, batch.column(2), strict=True):
                spans = [(run["start"], run["length"], run["period"]) for run in runs.as_py() or ()]
                out.append(finish(collapsed(text.as_py().split(), spans)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "collapsed"])

    return run


def collapse(df: DataFrame, text: str = "text", least: int = 24, into: str = "periods", digest: bool = False) -> DataFrame:
    """All columns of ``df`` and a struct ``into``: ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` has (start, period, length) of every run of ``least`` words and three periods or more, in order; ``collapsed``
    are the words that no run holds after its first period, joined by one space, or with ``digest`` the SHA-256 of that.
    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none. Every row comes back once, whatever repeats, with its
    columns as they were; one that is called ``into`` is replaced.
    """
    spark = df.sparkSession

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = new_path(spark, label)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    def finish(joined: bytes) -> str:
        return hashlib.sha256(joined).hexdigest() if digest else joined.decode()

    others = [name for name in df.columns if name != into]
    # Columns travel by number, so that no name can clash. A row's number is written down with it before anything refers to it.
    kept = F.struct(*[F.col(f"`{name}`").alias(f"c{place}") for place, name in enumerate(others)])
    given = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").cast("string").alias("text"), kept.alias("kept"))
    schema = f"{_TILE}, kept {given.schema['kept'].dataType.simpleString()}"
    found = written(given.mapInArrow(_look(least, finish), schema), "period-tiles")

    tiles = found.where(F.col("size").isNotNull()).select("row", "size", "start", "ids", "places")
    words = tiles.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    # Solving costs by the word, so the number of tasks follows from the words: small rows would else be put together.
    tiles = tiles.repartition(max(1, -(-words // TASK_WORDS)), "row", "size", "start")
    parts = tiles.mapInArrow(_solved(first_octave(least)), "row bigint, period bigint, start bigint, stop bigint")
    runs = stitched(parts, least).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    open_ = found.where(F.col("text").isNotNull())
    runs = written(open_.select("row", "text").join(runs, "row", "left"), "period-runs")
    ends = runs.select("row", "text", "runs").mapInArrow(_collapsed(finish), "row bigint, collapsed string")

    done = found.where(F.col("size").isNull() & F.col("text").isNull())
    done = done.select("kept", "words", F.array().cast(RUNS).alias("runs"), "collapsed")
    rest = open_.select("row", "kept", "words").join(runs.select("row", "runs"), "row").join(ends, "row")
    rest = rest.select("kept", "words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "collapsed")
    answer = F.struct(F.col("words").alias("n_words"), "runs", "collapsed").alias(into)
    return done.unionByName(rest).select(*[F.col(f"kept.c{place}").alias(name) for place, name in enumerate(others)], answer)


def with_period(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the words of every tenth text, by the crc32 of its key, made periodic from some word on.

    With h the crc32 of the key in decimal, g = floor(h / 10) and n words, texts with h % 10 = 0 and n > 0 have original word
    a + (i - a) % p for each word i from a = g % n on, p = 1 + floor((n - a) / (3 + g % 8)). A null key leaves its text alone.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})"), F.lit(1))
    g, n = F.floor(h / 10), F.size("_words")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    spread = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))
    chosen = df.withColumn("_words", F.when(h % 10 == 0, words))
    return chosen.withColumn(text, F.when(F.size("_words") > 0, F.array_join(spread, " ")).otherwise(F.col(f"`{text}`"))).drop("_words")


def highest(runs: str) -> Column:
    """The run of greatest length by period, compared exactly; of equals the one of least start, then period. Null without runs."""
    none = F.lit(None).cast(RUNS[6:-1])

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, none, better)


def listed(runs: str) -> Column:
    """Every run's ``start,length,period`` and a line feed, in order; empty without runs."""
    lines = F.transform(runs, lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return F.array_join(lines, "")
