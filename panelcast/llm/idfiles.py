"""Token ids of documents in binary shards, with a minimal perfect hash index for access by key.

A shard is two files. ``*.ids`` is nothing but ids, unsigned little-endian numbers of 2 or 4 bytes, documents one after
another in ascending key order. ``*.idx`` maps each distinct key to its place:

* header: ``MPHX0001``, then as unsigned 64-bit numbers: bytes per id, salt, documents, distinct keys, buckets;
* per bucket a signed 64-bit displacement: a seed (>= 0), or ``-1 - slot`` for a bucket of one key;
* per slot an unsigned 32-bit fingerprint of the key, and unsigned 64-bit first document and id offset in the shard;
* per document, in order: signed 64-bit key, one byte that is 1 for a null key, and 64-bit end offset (ids).

A key is hashed, its bucket's displacement gives its slot, and the fingerprint there must agree, which turns away nearly all
keys that are not there; the key stored with the document has the last word. All of these are read where they stand, so a
lookup takes a few small reads however large the index. ``manifest`` beside the shards is a Parquet table with one row per shard, written by Spark, so only
shards of tasks that succeeded count, however often an executor is lost.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encode import encoder
from .words import mix

MAGIC = b"MPHX0001"
#: Keys per bucket on average.
BUCKET = 4
#: Seeds tried at once.
TRIES = 64

MANIFEST = "shard bigint, file string, width bigint, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint"


#: Bytes of a shard's source, as the table stores them, from which on there are more shards than shuffle partitions.
SHARD_BYTES = 64 << 20
#: Bytes of ids read at once when whole shards are read.
READ_BYTES = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without scheme is local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without goes to the session's default file system, on the driver and the executors alike."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def stored_bytes(df: DataFrame) -> int:
    """What the optimizer takes the rows' size to be, from the files that hold them; nothing is read. 0 if it doesn't know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def key_hashes(keys: list[int], salt: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(b"%d" % key, salt) for key in keys), np.uint64, len(keys))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5BF03635F0935AD1)) >> np.uint64(32)).astype("<u4")


def slot_of(hashes: np.ndarray, seed, slots: int) -> np.ndarray:
    return mix(hashes ^ mix(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1))) % np.uint64(slots)


def displacements(keys: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Salt, displacement of each bucket and slot of each key: a minimal perfect hash of distinct keys."""
    count = len(keys)
    salt = 0
    while True:
        hashes = key_hashes(keys, salt)
        if len(np.unique(hashes)) == count:
            break
        salt += 1
    buckets = max(1, -(-count // BUCKET))
    home = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    taken = np.zeros(count, bool)
    slots = np.empty(count, np.int64)
    moved = np.zeros(buckets, np.int64)
    singles = []
    for bucket in np.argsort(-sizes, kind="stable").tolist():
        if sizes[bucket] <= 1:
            if sizes[bucket]:
                singles.append(bucket)
            continue
        members = order[starts[bucket] : starts[bucket + 1]]
        seed = 0
        while True:
            seeds = np.arange(seed, seed + TRIES, dtype=np.uint64)
            tried = np.sort(slot_of(hashes[members][None, :], seeds[:, None], count).astype(np.int64), axis=1)
            good = ~taken[tried].any(axis=1) & (np.diff(tried, axis=1) > 0).all(axis=1)
            if good.any():
                seed += int(np.argmax(good))
                break
            seed += TRIES
        places = slot_of(hashes[members], seed, count).astype(np.int64)
        taken[places] = True
        slots[members] = places
        moved[bucket] = seed
    for bucket, free in zip(singles, np.flatnonzero(~taken).tolist(), strict=True):
        slots[order[starts[bucket]]] = free
        moved[bucket] = -1 - free
    return salt, moved, slots


def index_bytes(keys: list[int | None], ends: np.ndarray, width: int) -> bytes:
    """The index file of a shard: ``keys`` of its documents in order (equal keys together), ``ends`` their end offsets."""
    firsts = [place for place, key in enumerate(keys) if key is not None and (place == 0 or keys[place - 1] != key)]
    distinct = [keys[place] for place in firsts]
    salt, moved, slots = displacements(distinct) if distinct else (0, np.zeros(1, np.int64), np.empty(0, np.int64))
    marks, documents, offsets = (np.zeros(len(distinct), kind) for kind in ("<u4", "<u8", "<u8"))
    if distinct:
        marks[slots] = fingerprints(key_hashes(distinct, salt))
        documents[slots] = firsts
        offsets[slots] = np.concatenate([[0], ends])[firsts]
    header = np.array([width, salt, len(keys), len(distinct), len(moved)], "<u8")
    named = np.array([0 if key is None else key for key in keys], "<i8")
    missing = np.array([key is None for key in keys], "u1")
    arrays = [header, moved.astype("<i8"), marks, documents, offsets, named, missing, ends.astype("<u8")]
    return MAGIC + b"".join(array.tobytes() for array in arrays)


@dataclass(frozen=True)
class Index:
    """An index file in memory."""

    width: int
    salt: int
    moved: np.ndarray
    marks: np.ndarray
    documents: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    missing: np.ndarray
    ends: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Index:
        if data[:8] != MAGIC:
            raise ValueError("Not an index file")
        width, salt, docs, distinct, buckets = np.frombuffer(data, "<u8", 5, 8).tolist()
        at, arrays = 48, []
        for kind, count in (("<i8", buckets), ("<u4", distinct), ("<u8", distinct), ("<u8", distinct), ("<i8", docs), ("u1", docs), ("<u8", docs)):
            arrays.append(np.frombuffer(data, kind, count, at))
            at += arrays[-1].nbytes
        return cls(width, salt, *arrays)

    def find(self, key: int) -> tuple[int, int] | None:
        """First document of a key in this shard and the offset of its ids, or None."""
        if not len(self.marks):
            return None
        hashed = key_hashes([key], self.salt)
        moved = int(self.moved[int(hashed[0] % np.uint64(len(self.moved)))])
        slot = -1 - moved if moved < 0 else int(slot_of(hashed, moved, len(self.marks))[0])
        if self.marks[slot] != fingerprints(hashed)[0]:
            return None
        return int(self.documents[slot]), int(self.offsets[slot])


def write_ids(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1) -> None:
    """Encode every text and write the shards and the manifest below ``path``.

    Documents are range-partitioned and sorted by key (null first) and, among equal keys, by a hash of the text, so a
    repeated key can't make a shard larger than its distinct texts need. Null texts count as empty. Keys are whole
    numbers and may repeat. Columns other than these two are not read.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    ordering = [F.col("key").asc_nulls_first(), F.col("tie")]
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    spark = df.sparkSession
    path = qualified(spark, path)
    shards = -(-stored_bytes(rows.select("key", "text")) // SHARD_BYTES)
    more = [shards] if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    rows = rows.repartitionByRange(*more, *ordering).sortWithinPartitions(*ordering).select("key", "text")

    def run(batches):
        tool = encoder(tokenizer)
        width = 2 if max(tool.tokenizer.get_vocab_size(), end_id or 0) <= 1 << 16 else 4
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        system, folder = opened(path)
        keys, ends, total, out = [], [], 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}.ids")
                keys += batch.column(0).to_pylist()
                for value in batch.column(1):
                    ids = np.frombuffer(tool.encode(value.as_py() or "") + end, "<u4")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    total += len(ids)
                    ends.append(total)
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        with system.open_output_stream(f"{folder}/{name}.idx") as index:
            index.write(index_bytes(keys, np.array(ends, np.int64), width))
        known = [key for key in keys if key is not None]
        row = [number, name, width, len(keys), total, known[0] if known else None, known[-1] if known else None]
        kinds = [pa.string() if place == 1 else pa.int64() for place in range(7)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([value], kind) for value, kind in zip(row, kinds, strict=True)],
            ["shard", "file", "width", "n_docs", "n_ids", "first_key", "last_key"],
        )

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard, with ``base``: the ids in all shards before it. The window is over shards, not documents."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """All documents from the files: the key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, and ``ids``.

    Every key is looked up in its shard's index, and its ids are read where the index says they begin.
    """
    path = qualified(spark, path)
    shards = manifest(spark, path)
    count = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").count()
    shards = shards.select("shard", "file", "base").repartitionByRange(max(1, count), "shard")
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        system, folder = opened(path)
        for batch in batches:
            for shard in batch.to_pylist():
                with system.open_input_stream(f"{folder}/{shard['file']}.idx") as file:
                    index = Index.read(file.read())
                with system.open_input_file(f"{folder}/{shard['file']}.ids") as payload:
                    yield from documents(index, payload, shard["base"])

    def documents(index, payload, base):
        lengths = np.diff(index.ends, prepend=np.uint64(0)).astype(np.int64).tolist()
        rows, held = [], 0
        offset, current = 0, None
        buffer, begin = b"", 0
        for place, (name, missing, length) in enumerate(zip(index.keys.tolist(), index.missing.tolist(), lengths, strict=True)):
            if not missing and (place == 0 or name != current):
                found = index.find(name)
                if found is None or found[0] != place:
                    raise ValueError(f"Index and shard disagree about key {name}")
                offset, current = found[1], name
            at, size = offset * index.width, length * index.width
            if not begin <= at <= at + size <= begin + len(buffer):
                begin, buffer = at, payload.read_at(max(size, READ_BYTES), at)
            ids = np.frombuffer(buffer, f"<u{index.width}", length, at - begin)
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            rows.append((None if missing else name, base + offset, length, crc, ids.astype(np.int64) if with_ids else None))
            offset += length
            held += length if with_ids else 1
            if held >= 1 << 18:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    def table(rows):
        columns = [pa.array([row[place] for row in rows], pa.int64()) for place in range(4)]
        if with_ids:
            columns.append(pa.array([row[4] for row in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names)

    return shards.mapInArrow(run, schema)


class IdFiles:
    """Access by key from one process, without Spark: a binary search among shards, then a few small reads."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq

        self.system, self.folder = opened(path)
        table = pq.read_table(f"{self.folder}/manifest", filesystem=self.system).sort_by("shard")
        self.shards = [row for row in table.to_pylist() if row["first_key"] is not None]
        self.last_keys = [row["last_key"] for row in self.shards]
        self.header = lru_cache(maxsize=4096)(self._header)

    def _header(self, file: str) -> tuple[int, ...]:
        with self.system.open_input_file(f"{self.folder}/{file}.idx") as stream:
            data = stream.read_at(48, 0)
        if data[:8] != MAGIC:
            raise ValueError("Not an index file")
        return tuple(np.frombuffer(data, "<u8", 5, 8).tolist())

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each document with this key, in order; empty if there is none."""
        found = []
        for shard in self.shards[bisect_left(self.last_keys, key) :]:
            if shard["first_key"] > key:
                break
            found += self._in_shard(shard["file"], key)
        return found

    def _in_shard(self, file: str, key: int) -> list[np.ndarray]:
        width, salt, docs, distinct, buckets = self.header(file)
        places, at = [], 48
        for size, count in ((8, buckets), (4, distinct), (8, distinct), (8, distinct), (8, docs), (1, docs), (8, docs)):
            places.append(at)
            at += size * count
        moved_at, marks_at, documents_at, offsets_at, keys_at, missing_at, ends_at = places
        found: list[np.ndarray] = []
        with self.system.open_input_file(f"{self.folder}/{file}.idx") as index:

            def number(start: int, place: int, kind: str) -> int:
                size = np.dtype(kind).itemsize
                return int(np.frombuffer(index.read_at(size, start + size * place), kind)[0])

            hashed = key_hashes([key], salt)
            moved = number(moved_at, int(hashed[0] % np.uint64(buckets)), "<i8")
            slot = -1 - moved if moved < 0 else int(slot_of(hashed, moved, distinct)[0])
            if number(marks_at, slot, "<u4") != fingerprints(hashed)[0]:
                return found
            document, offset = number(documents_at, slot, "<u8"), number(offsets_at, slot, "<u8")
            with self.system.open_input_file(f"{self.folder}/{file}.ids") as payload:
                while document < docs and number(keys_at, document, "<i8") == key and not number(missing_at, document, "u1"):
                    end = number(ends_at, document, "<u8")
                    found.append(np.frombuffer(payload.read_at((end - offset) * width, offset * width), f"<u{width}"))
                    offset, document = end, document + 1
        return found

    def __getitem__(self, key: int) -> np.ndarray:
        found = self.get(key)
        if not found:
            raise KeyError(key)
        return found[0]
