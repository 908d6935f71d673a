"""Packing documents into windows of at most ``size`` tokens by Karmarkar-Karp multiway differencing.

A document is cut into whole windows and a rest, and the rest into slices of at most ``slice_size`` tokens. The
slices of a batch are divided among k windows: each slice starts as a partial partition, and the two partial
partitions of greatest imbalance are merged again and again, the fuller windows of one with the emptier of the
other, until one partition is left. k starts at the least number that could hold the batch and rises whenever a window
would be over capacity, so the windows come out nearly equally full.

Batches are made where the documents lie, one after another within a task: rows are not shuffled, a task holds one
batch, and no key can make a task larger. A window's id has the task's number in its upper bits. Up to one window's
worth of padding per batch is the price; ``batch`` slices make some hundreds of windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import REMEMBERED, encoder

#: Windows a task can number before ids of two tasks would meet.
PER_TASK = 1 << 36


def difference(lengths: list[int], windows: int) -> np.ndarray:
    """The window of each length, by Karmarkar-Karp differencing into ``windows`` parts of nearly equal sums."""
    count = len(lengths)
    if windows <= 1 or not count:
        return np.zeros(count, np.int64)
    # A partial partition is its nonzero sums in falling order and, for each, a node of the tree of merged slices.
    left, right = [-1] * count, [-1] * count
    queue = [(-length, place, np.array([length]), np.array([place])) for place, length in enumerate(lengths)]
    heapq.heapify(queue)
    serial = count
    while len(queue) > 1:
        _, _, sums, nodes = heapq.heappop(queue)
        _, _, more_sums, more_nodes = heapq.heappop(queue)
        over = len(sums) + len(more_sums) - windows
        if over > 0:
            # The fullest windows meet empty ones; what is left of both meets in opposite order.
            start, tail = len(sums) - over, more_sums[::-1][:over]
            merged = np.arange(len(left), len(left) + over)
            left.extend(nodes[start:].tolist())
            right.extend(more_nodes[::-1][:over].tolist())
            sums = np.concatenate([sums[:start], sums[start:] + tail, more_sums[: len(more_sums) - over]])
            nodes = np.concatenate([nodes[:start], merged, more_nodes[: len(more_nodes) - over]])
        else:
            sums, nodes = np.concatenate([sums, more_sums]), np.concatenate([nodes, more_nodes])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(queue, (int(least - sums[0]), serial, sums, nodes))
        serial += 1
    part = np.empty(count, np.int64)
    for window, root in enumerate(queue[0][3].tolist()):
        stack = [root]
        while stack:
            node = stack.pop()
            if node < count:
                part[node] = window
            else:
                stack += (left[node], right[node])
    return part


def windows_of(lengths: list[int], size: int) -> tuple[np.ndarray, int]:
    """The window of each length and the number of windows; no window holds more than ``size``."""
    total = sum(lengths)
    count = max(1, -(-total // size))
    while True:
        part = difference(lengths, count)
        most = int(np.bincount(part, weights=lengths, minlength=count).max()) if lengths else 0
        if most <= size:
            return part, count
        count += 1


def slices(tokens: int, size: int, slice_size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole windows, then slices of the rest."""
    whole = tokens // size * size
    for start in range(0, whole, size):
        yield start, size
    rest = tokens - whole
    if rest:
        parts = -(-rest // slice_size)
        start = whole
        for part in range(parts):
            length = min(slice_size, rest - part * slice_size)
            yield start, length
            start += length


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1, size: int = 2048,
    slice_size: int = 512, batch: int = 2048, with_ids: bool = True, remembered: int = REMEMBERED,
) -> DataFrame:
    """Pieces of all documents and their places in windows.

    One row per piece: the key, ``start`` (its document's tokens before it), ``length``, ``ids_crc32`` (of its ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id`` and ``offset`` (its place in that window,
    gapless from 0), and with ``with_ids`` the ``ids`` themselves. ``end_id`` is appended to each document.

    Null texts count as empty; a document without any token (empty, no ``end_id``) has no piece. Keys may be null or
    repeat: each row is packed as a document of its own. Columns of ``df`` other than these two are not read. A worker
    holds the ids of up to twice ``remembered`` words; this bounds its memory and changes no result.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        tool = encoder(tokenizer, remembered)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) * PER_TASK

        def out(rows, ids):
            columns = [pa.array([row[0] for row in rows], key_type)]
            columns += [pa.array([row[place] for row in rows], pa.int64()) for place in range(1, 7)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names)

        full, full_ids, loose, loose_ids = [], [], [], []

        def place(loose, ids):
            nonlocal number
            part, count = windows_of([row[2] for row in loose], size)
            filled = [0] * count
            placed = []
            for row, window in zip(loose, part.tolist(), strict=True):
                placed.append((*row, number + window, filled[window]))
                filled[window] += row[2]
            number += count
            return out(placed, ids)

        key_type = pa.int64()
        for incoming in batches:
            key_type = incoming.schema.field(0).type
            for name, value in zip(incoming.column(0).to_pylist(), incoming.column(1), strict=True):
                ids = tool.encode(value.as_py() or "") + end
                tokens = len(ids) // 4
                for start, length in slices(tokens, size, slice_size):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (name, start, length, zlib.crc32(piece), tokens)
                    if length == size:
                        full.append((*row, number, 0))
                        full_ids.append(piece if with_ids else b"")
                        number += 1
                    else:
                        loose.append(row)
                        loose_ids.append(piece if with_ids else b"")
                    if len(full) >= batch:
                        yield out(full, full_ids)
                        full, full_ids = [], []
                    if len(loose) >= batch:
                        yield place(loose, loose_ids)
                        loose, loose_ids = [], []
        if full:
            yield out(full, full_ids)
        if loose:
            yield place(loose, loose_ids)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema + ", ids array<bigint>" * with_ids)


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """The windows as model input: ``sequence_id``, ``ids`` padded to ``size`` with ``pad_id``, ``n_tokens`` before padding.

    ``pieces`` is what ``pack(..., with_ids=True)`` returns. A window holds at most ``size`` tokens, so grouping
    by window is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda part: part["ids"]))
    joined = pieces.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))
    padding = F.array_repeat(F.lit(pad_id).cast("bigint"), F.lit(size) - F.size("ids"))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"), "n_tokens")
