"""Byte-pair encoding and decoding.

Encoding keeps a word's symbols in a doubly linked list and its adjacent pairs in a priority queue by merge
rank (ties: leftmost first). The best pair is merged, its neighbours' new pairs are queued, and queue entries
whose symbols have changed since are skipped: O(n log n) for a word of n bytes, however long. Decoding joins the
vocabulary's byte strings. Ids equal those of the tokenizers library without special tokens added; strings of
special tokens inside a text become their ids, as in the library.

Words repeat, so each Python worker remembers a bounded number of them. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .encode import Memory, byte_letters, safe_words, spaced_words, stands_alone

#: Fixed value: the words that byte-level tokenizers take apart.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Codec:
    """Encode and decode with a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules["pre_tokenizer"]
        if before["type"] != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or rules["normalizer"]:
            raise ValueError("Only byte-level vocabularies without normalizer are supported")
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        vocabulary: dict[str, int] = rules["model"]["vocab"]
        self.specials = {token["content"]: token["id"] for token in rules["added_tokens"]}
        self.start = [vocabulary[letter] for letter in letters]
        self.strings: dict[int, bytes] = {
            id_: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, id_ in vocabulary.items()
        }
        self.strings |= {id_: token.encode() for token, id_ in self.specials.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(rules["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.memory = Memory(self._plain, stands_alone)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.start[byte] for byte in word]
        count, merges = len(ids), self.merges
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        queue = []
        for place in range(count - 1):
            found = merges.get((ids[place], ids[place + 1]))
            if found:
                queue.append((found[0], place, ids[place], ids[place + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, place, left, right, merged = heapq.heappop(queue)
            follower = after[place]
            if ids[place] != left or follower >= count or ids[follower] != right:
                continue  # one of the two symbols has gone since
            ids[place], ids[follower] = merged, -1
            following = after[place] = after[follower]
            if following < count:
                before[following] = place
                found = merges.get((merged, ids[following]))
                if found:
                    heapq.heappush(queue, (found[0], place, merged, ids[following], found[1]))
            leading = before[place]
            if leading >= 0:
                found = merges.get((ids[leading], merged))
                if found:
                    heapq.heappush(queue, (found[0], leading, ids[leading], merged, found[1]))
        return [id_ for id_ in ids if id_ >= 0]

    def _plain(self, text: str) -> bytes:
        """Ids of a text in which strings of special tokens have no meaning, as unsigned 32-bit numbers."""
        ids: list[int] = []
        for word in WORDS.findall(text):
            ids += self.merge(word.encode())
        return np.array(ids, "<u4").tobytes()

    def _words(self, text: str) -> bytes:
        try:
            return b"".join(map(self.memory.__getitem__, spaced_words(text)))
        except TypeError:  # white space beside a space: fewer places to cut
            found = ((word, self.memory[word]) for word in safe_words(text))
            return b"".join(self._plain(word) if ids is None else ids for word, ids in found)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if self.cut is None or not any(special in text for special in self.specials):
            return np.frombuffer(self._words(text), "<u4")
        parts = (
            np.array([self.specials[part]], "<u4").tobytes() if part in self.specials else self._words(part) for part in self.cut.split(text) if part
        )
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary add nothing."""
        if not len(ids):
            return ""
        table = self._table()
        if ids.min() < 0 or ids.max() >= len(table):
            ids = ids[(ids >= 0) & (ids < len(table))]
        return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def _table(self) -> list[bytes]:
        if not hasattr(self, "_strings"):
            self._strings = [self.strings.get(id_, b"") for id_ in range(max(self.strings) + 1)]
        return self._strings


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(path)


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts one at a time, so that a batch is never held twice; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Append the ids of each text as an array column; null texts count as empty. Other columns stay; one named ``into`` is replaced."""
    kept = df.drop(into)
    schema = StructType([*kept.schema.fields, StructField(into, ArrayType(LongType()), False)])

    def run(batches):
        tool = codec(path)
        for batch in batches:
            ids = [tool.encode(value).astype(np.int64) for value in _texts(batch.column(batch.schema.get_field_index(text)))]
            yield _appended(batch, into, pa.array(ids, pa.list_(pa.int64())))

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Append the text of each array of ids; null arrays give an empty text, ids that are null, negative or outside the vocabulary
    add nothing. Other columns stay; one named ``into`` is replaced."""
    kept = df.drop(into)
    schema = StructType([*kept.schema.fields, StructField(into, StringType(), False)])

    def run(batches):
        tool = codec(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [tool.decode(np.asarray(value.values.drop_null() if value.is_valid else [], np.int64)) for value in column]
            yield _appended(batch, into, pa.array(texts, pa.string()))

    return kept.mapInArrow(run, schema)


def _appended(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: (key, ids_text, decoded), ids as decimal numbers joined by commas."""
    import hashlib

    def run(batches):
        tool = codec(path)
        comma = [str(id_) for id_ in range(max(tool.strings) + 1)]
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for value in _texts(batch.column(1)):
                ids = tool.encode(value)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(comma.__getitem__, ids.tolist())).encode()).hexdigest())
                text_hash.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
