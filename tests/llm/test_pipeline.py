"""Registered queries against SQL, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import collections
import random

import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entries
import corpus_pipeline
from panelcast.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_equals_sql(spark, sf, name):
    got = entries.queries()[name](spark, sf).toPandas()
    want = oracle.connect(sf).execute(entries.oracle_sql()[name]).fetchdf()
    assert len(want) > 0
    assert oracle.difference(got, want) is None


def test_registered():
    names = set(entries.queries())
    assert "pipeline" in names
    assert [sum(name.startswith(f"op{number}_") for name in names) for number in range(1, 14)] == [1] * 13


def test_contracts(spark, sf):
    packed = catalog.op1_packing(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(packed.columns)
    scored = catalog.op3_toxicity(spark, sf)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}


def test_pipeline(spark, sf):
    docs = catalog.table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, docs, sf).cache()
        assert following.columns == corpus_pipeline.COLUMNS, name
        rows, earlier = following.collect(), {row.doc_id: row for row in docs.collect()}
        assert {row.doc_id for row in rows} <= set(earlier) and all(row.n_chars == len(row.text) for row in rows)
        if name == "quality rules":
            report = {row.doc_id: row.kept for row in catalog.op7_quality(spark, sf).collect()}
            assert {row.doc_id for row in rows} == {key for key, kept in report.items() if kept}
        if name == "n-gram Jaccard join":
            grams = {}
            for row in earlier.values():
                words = row.text.split()
                grams[row.doc_id] = {tuple(words[p : p + 5]) for p in range(len(words) - 4)} or {tuple(words)}
            kept = set()
            seen = set()
            for key in sorted(grams):
                if key in seen:
                    continue
                kept.add(key)
                stack = [key]
                while stack:
                    at = stack.pop()
                    if at not in seen:
                        seen.add(at)
                        stack += [other for other in grams if other not in seen and len(grams[at] & grams[other]) >= 0.8 * len(grams[at] | grams[other])]
            assert {row.doc_id for row in rows} == kept
        docs = following
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = collections.Counter()
    for row in corpus_pipeline.run(spark, sf).collect():
        tokens[row.doc_id] += row.length
    assert tokens == {row.doc_id: len(tokenizer.encode(row.text, add_special_tokens=False).ids) + 1 for row in docs.collect()}
    assert len(tokens) < before


WORDS = "the of and to in is that it for was on with as by at from this have be are or an they which you one we all there their".split()


def prose(seed: int, count: int = 120) -> list[str]:
    rnd = random.Random(seed)
    return [rnd.choice(WORDS) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(3, 9))) for _ in range(count)]


def test_rows_that_repeat_a_key(spark):
    """A text that has nothing to do with a group stays, though its key goes; of equal rows one stays."""
    a, b, c = (" ".join(prose(seed)) for seed in (1, 2, 3))
    near = " ".join([*a.split()[:-1], "end"])
    rows = [(1, a), (2, near), (2, b), (3, c), (3, c), (3, c), (4, a), (1, near), (5, None), (5, None), (None, a), (6, ""), (6, c)]
    docs = spark.createDataFrame([(key, text, "en", "s", 0) for key, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    left = sorted(((row.doc_id or 0, row.text or "") for row in got.collect()))
    first = [(1, text) for text in (a, near)]
    assert [row for row in left if row not in first] == sorted([(0, a), (2, b), (3, c), (5, ""), (6, "")])
    assert sum(row in first for row in left) == 1


def test_run_over_awkward_documents(spark, tmp_path):
    long = " ".join(prose(9, 60_000))
    texts = [None, "", "short", " ".join(prose(1)), " ".join(prose(1)), " ".join(prose(2)), long, "x" * 200_000, "x@" + "a." * 5000 + "com " + " ".join(prose(4)), "\n".join(prose(5))]
    rows = [(place // 2, text, "en", f"s{place % 3}", 0, place) for place, text in enumerate(texts)] + [(3, long, "en", "s0", 0, 1), (None, " ".join(prose(6)), "en", "s1", 0, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sequence_id int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(row.length for row in pieces if row.doc_id == 3) > 60_000
    assert max(row.length + row.offset for row in pieces) <= 2048
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
