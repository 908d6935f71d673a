"""Texts that real pages hold: long runs without spaces, numbers beside numbers, letters that change when normalised."""

from __future__ import annotations

import random
import re
import time
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelcast.llm import bpe, pii
from panelcast.llm.encode import Encoder

LETTERS = [
    *"abcdefgzABCXYZ019 ,.;:!?'\"-_()<>=/\n\t\r  İıßÀéèñøŒœſçÇğĞŞÖö中あ😀ΣςσΩÅẞ²½٣Ⅷ�힣ʹ;·K", "́", "̇", "̧", "̸", "‍", " ",
    " ", "　", "\u0085", "क़", "क़", "각", "Ǆ", "ﬁ", "İ", "İ", "ͅ", "Ϊ", "ΐ",
    "'s", "'re", "'LL", "'ve", "<|endoftext|>", "\x00", "\U0001d400",
]
WORDS = ["ALİ,", "İSTANBUL", "geldi", "BELEDİYESİ.", "don't", "it's", "Straße", "naïve", "hello", "world,", "foo\nbar", "x\n\ny", "École.", "ÉCOLE!"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_random_texts(name):
    rnd, path = random.Random(7), public_tokenizers.path(name)
    tokenizer, encoder = Tokenizer.from_file(path), Encoder(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    codec = bpe.Codec(path) if name.startswith("byte") else None
    for _ in range(50_000):
        parts = [rnd.choice(WORDS) + rnd.choice(["", " ", "\n"]) if rnd.random() < 0.25 else rnd.choice(LETTERS) for _ in range(rnd.randint(0, 12))]
        text = "".join(parts)
        want = array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        assert encoder.encode(text) == want, text
        if codec:
            assert codec.encode(text).tobytes() == want, text


def test_ids_outside_the_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    a, b = bpe.Codec(path).encode("good day").tolist()
    rows = [(1, [a, -1, b]), (2, [a, 10**9, None, b]), (3, [-5]), (4, [None]), (5, []), (6, None), (7, [a, b])]
    got = {row["id"]: row["decoded"] for row in bpe.decode(spark.createDataFrame(rows, "id int, ids array<long>"), path).collect()}
    assert got == {1: "good day", 2: "good day", 3: "", 4: "", 5: "", 6: "", 7: "good day"}


def replaced(spark, texts: list[str], key: str = "k") -> list:
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return pii.pseudonymise(df, key).orderBy("id").collect()


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if place % 2 else int(d) for place, d in enumerate(digits[::-1])) % 10 == 0


def test_numbers_beside_numbers(spark):
    card, alone = "4111 1111 1111 1111", "4111111111111111"
    texts = [
        f"{card}", f"{card} 12/27", f"{alone} 123", f"1 {card}", f"12 345 6780 {card}", f"{card} {card} 27", f"1234 5678 {card}", "3782 822463 10005 4",
        f"{card} 2024-01-02",
    ]
    rows = replaced(spark, texts)
    new = rows[0]["found"][0]["value"]
    assert luhn(new.replace(" ", "")) and new[0] == "4" and new != card
    assert rows[1]["text"] == f"{new} 12/27" and rows[3]["text"] == f"1 {new}" and rows[4]["text"] == f"12 345 6780 {new}"
    assert rows[2]["text"] == f"{new.replace(' ', '')} 123" and rows[5]["text"] == f"{new} {new} 27" and rows[6]["text"] == f"1234 5678 {new}"
    assert "3782 822463 10005" not in rows[7]["text"] and rows[7]["text"].endswith(" 4")
    assert [found["kind"] for found in rows[8]["found"]] == ["card", "date"] and rows[8]["text"].startswith(new)


def test_banks_beside_words(spark):
    rows = replaced(spark, ["BE68 5390 0754 7034", "BE68 5390 0754 7034 BIC", "ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1332 EUR", "DE89370400440532013000."])
    assert rows[1]["text"] == rows[0]["text"] + " BIC" != "BE68 5390 0754 7034 BIC"
    assert rows[3]["text"] == rows[2]["text"] + " EUR" != "ES91 2100 0418 4502 0005 1332 EUR"
    assert [row["found"][0]["kind"] for row in rows] == ["iban"] * 5


def test_phones_keep_their_links(spark):
    rows = replaced(spark, ["+1 375 555 4393", "+1 375 555 4393 27", "call +1 375 555 4393, 2024", "+44 20 7946 0958", "+44 20 7946 0958 12"])
    new = rows[0]["found"][0]["value"]
    assert rows[1]["text"] == f"{new} 27" and rows[2]["text"] == f"call {new}, 2024" and new != "+1 375 555 4393"
    assert rows[4]["text"] == rows[3]["text"] + " 12"


def test_long_runs_take_linear_time(spark):
    size = 400_000
    texts = [
        "x" * size + " 1", "a1" * (size // 2), "x@" + "a." * 100_000 + "com", "." * 100_000 + " 1@", "1 " * (size // 2), "1-" * (size // 2), "4111 1111 " * (size // 10),
        "@a" * (size // 2), "password=" + "a" * size, "+1" * (size // 2), "AB12" * (size // 4), "A1 " * (size // 3), "1." * (size // 2), "(" * size + "1", "a@b." * (size // 4),
    ]
    replaced(spark, ["warm 1 a@b.org 4111 1111 1111 1111"])
    for text in texts:
        began = time.monotonic()
        assert len(replaced(spark, [text])) == 1
        assert time.monotonic() - began < 20, text[:20]


def test_the_key_is_in_no_plan(spark):
    df = spark.createDataFrame([(1, "a@b.org")], "id int, text string")
    done = pii.pseudonymise(df, "very secret key")
    done.collect()
    assert "very secret" not in done._jdf.queryExecution().toString() + done._sc._jvm.PythonSQLUtils.explainString(done._jdf.queryExecution(), "extended")
    assert done.first()["text"] != pii.pseudonymise(df, "another key").first()["text"]


def plain_kinds(text: str) -> list[str]:
    """What a plain reading finds: cards by grouping and check digit, addresses, dates and e-mail."""
    found = [("email", m.start()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", text, re.A)]
    for m in re.finditer(r"(?<![\d./-])\d{4}-(\d\d)-(\d\d)(?![\d/-])", text):
        try:
            np.datetime64(m[0])
            found.append(("date", m.start()))
        except ValueError:
            pass
    found += [("address", m.start()) for m in re.finditer(r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d|\.\d)", text) if all(int(g) < 256 for g in m.groups())]
    found += [("card", m.start()) for m in re.finditer(r"(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)", text) if luhn(re.sub(r"\D", "", m[0]))]
    return sorted(kind for kind, _ in found)


def test_counts_over_documents(spark, sf):
    """Every e-mail, address, ISO date and grouped card that a plain reading finds is replaced, and no more of these."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    total = 0
    for row in pii.pseudonymise(df, "k", into="found").join(df.withColumnRenamed("text", "old"), "doc_id").collect():
        want = plain_kinds(row["old"] or "")
        iso = [f["kind"] for f in row["found"] if f["kind"] in ("email", "address") or f["kind"] == "date" and f["value"][4] == "-" or f["kind"] == "card" and len(f["value"]) == 19]
        assert sorted(iso) == want, row["doc_id"]
        total += len(want)
    assert total > 10
