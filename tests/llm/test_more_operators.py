"""Periodic runs, whitening and URL filters against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import catalog, periods, urls, whitening

# --- periodic runs ------------------------------------------------------------------------------


def plain_runs(words: list, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, period, length) by trying every period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at > start and at + q - start >= max(least, 3 * q):
                found.setdefault((start, at + q), q)
            at += 1
    return sorted((start, q, stop - start) for (start, stop), q in found.items())


def plain_collapse(words: list[str], runs) -> str:
    gone = {place for start, q, length in runs for place in range(start + q, start + length)}
    return " ".join(word for place, word in enumerate(words) if place not in gone)


def plain_period(doc_id, text: str | None) -> list[str]:
    words = [word.decode() for word in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def some_words(seed: int, count: int) -> list[str]:
    rnd, words = random.Random(seed), []
    while len(words) < count:
        block = [f"w{rnd.randint(0, rnd.choice([0, 1, 3, 50]))}" for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 31, 40]))]
        words += (block * 30)[: rnd.randint(1, 6 * len(block) + 10)] if rnd.random() < 0.6 else block
    return words[:count]


@pytest.mark.parametrize("least", [24, 9])
def test_runs_equal_brute_force(spark, least):
    lists = [some_words(seed, seed % 260) for seed in range(600)]
    special = [[], ["a"], ["a"] * 5000, ["a", "b"] * 40, [f"u{i}" for i in range(3000)], ([f"p{i}" for i in range(700)] * 4)[:2500]]
    texts = ["\t".join(words) if place % 2 else "  \n".join(words) + " " for place, words in enumerate(lists + special)]
    rows = [(None if place == 3 else place // 2, text, "x", 1) for place, text in enumerate([*texts, None, "", " \x0b ", "é\u2003x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, row int")
    got = periods.collapse(df, least=least).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    for row in got:
        words = [word.decode() for word in (row["text"] or "").encode().split()]
        want = plain_runs(words, least)
        assert [tuple(run) for run in row["periods"]["runs"]] == want
        assert row["periods"]["collapsed"] == plain_collapse(words, want)
        assert row["periods"]["n_words"] == len(words) and row["runs"] == "x"


def test_long_text_is_cut_into_tiles(spark, monkeypatch):
    block = [f"b{i}" for i in range(1500)]
    words = [f"u{i}" for i in range(10_001)] + block * 7 + ["z"] * 9000 + block[:400] * 3
    df = spark.createDataFrame([(1, " ".join(words))] * 2, "doc_id long, text string")
    for row in periods.collapse(df).collect():
        assert [tuple(run) for run in row["periods"]["runs"]] == [(10_001, 1500, 10_500), (20_501, 1, 9000), (29_501, 400, 1200)]


def test_no_texts(spark):
    assert periods.collapse(spark.createDataFrame([], "text string, periods int")).collect() == []


def test_periodic_runs_query(spark, sf):
    texts = catalog.table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {row["doc_id"]: row for row in catalog.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        words = plain_period(doc_id, text)
        runs = plain_runs(words)
        row = got[doc_id]
        assert row["n_runs"] == len(runs)
        listed = "".join(f"{start},{length},{q}\n" for start, q, length in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
        best = max(runs, key=lambda run: (run[2] / run[1], -run[0], -run[1]), default=(None, None, None))
        assert (row["start"], row["period"], row["length"]) == best
        assert row["exponent_milli"] == (1000 * best[2] // best[1] if runs else None)


# --- whitening ----------------------------------------------------------------------------------


def plain_whitening(vectors: list, wanted: int = 16):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    centre = (x * len(fit) - fit.sum(axis=0)) / len(fit)
    apart = (fit * len(fit) - fit.sum(axis=0)) / len(fit)
    values, directions = np.linalg.eigh(apart.T @ apart / len(fit))
    values, directions = values[::-1][:wanted], directions[:, ::-1][:, :wanted]
    exact = [[len(fit) * int(v) - int(s) for v, s in zip(row, fit.sum(axis=0), strict=True)] for row in x]
    return values, centre @ directions / np.sqrt(values), [sum(v * v for v in row) for row in exact], len(fit), np.trace(apart.T @ apart / len(fit))


def check_whitening(rows, vectors: dict, wanted: int = 16):
    values, white, apart, n, trace = plain_whitening(list(vectors.values()), wanted)
    place = {key: at for at, key in enumerate(vectors)}
    got = np.zeros_like(white)
    for row in rows:
        got[place[row["vec_id"]], row["component"] - 1] = row["whitened"]
        assert row["n"] == n and row["deviation"] == apart[place[row["vec_id"]]] and row["identity_error"] < 1e-10
        assert abs(row["explained"] * trace / values[row["component"] - 1] - 1) < 1e-10
    assert len(rows) == white.size
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-8
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-8


def test_whitening_query(spark, sf):
    table = catalog.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    check_whitening(catalog.op12_whitening(spark, sf).collect(), dict(map(tuple, table)))


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    vectors = {key: (rng.standard_normal(9) * np.arange(1, 10)).tolist() for key in range(200)}
    vectors |= {key: vectors[7] for key in range(200, 260)}
    vectors[261] = [0.0] * 9
    bad = [(300, None, 1.0, 0), (301, [1.0, None] + [0.0] * 7, 1.0, 0), (302, [float("nan")] * 9, 1.0, 0), (303, [float("inf")] + [0.0] * 8, 1.0, 0)]
    rows = [(key, vector, 2.5, 7) for key, vector in vectors.items()] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, x int")
    check_whitening(whitening.whiten(df).collect(), vectors)
    check_whitening(whitening.whiten(df, wanted=3).collect(), vectors, 3)
    same = df.where("vec_id >= 200 and vec_id < 260")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 300")).count() == 0
    short = spark.createDataFrame([(None, [1.0]), (None, [1.0]), (1, [1.0, 2.0]), (2, []), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(short).collect()
    assert len(got) > 0 and sum(row["vec_id"] is None for row in got) == 2 * max(row["component"] for row in got)
    assert all(row["deviation"] is None or row["deviation"] >= 0 for row in got)


@pytest.mark.parametrize("seed", range(4))
def test_certified_components(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(60, 200))
    values = np.sort(rng.uniform(0.5, 1, size))[::-1] * np.where(np.arange(size) < seed * 3, 50.0, 1.0)
    if seed == 3:
        values[10:30] = values[10]  # equal values across the edge of what is wanted
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = turn * values @ turn.T
    got, directions, passes = whitening.components(lambda block: matrix @ block, size, 16, values.sum())
    assert np.abs(got - np.sort(values)[::-1][:16]).max() < 1e-10 * values.max() and passes > 3
    assert np.abs(matrix @ directions - directions * got).max() < 1e-10 * values.max()
    assert np.abs(directions.T @ directions - np.eye(16)).max() < 1e-12


# --- URL filters --------------------------------------------------------------------------------


def plain_judge(url: str | None, rules) -> tuple:
    rest = url.partition("://")[2] if url and "://" in url else ""
    ends = [rest.find(mark) for mark in "/?#" if mark in rest]
    host, rest = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min((rest.find(mark) for mark in "?#" if mark in rest), default=len(rest))]
    best = None
    for rule in rules:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
            best = rule
    return host, path, best and best.text, best and best.verdict


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.NET/EN/x", "x://example.net/en/?a=1", "http://a.example.net/en", "http://notnet/",
    "http://net/", "http://net", "http://net?x/", "http://b.net#/a", "https://ÄÖ.org/fr/é#?", "http://org/fr/a?b#c", "http://x.org/fra", "a://b://c.org/fr/",
    "http://evilexample.com/de/", "http://example.com/de/\n?x", "http://example.com.net/de/", "?://x.net/", "http://user@h.net:80/p", "http://" + "a." * 50_000 + "net/" + "x" * 200_000,
]


def test_rules_equal_plain(spark):
    rows = [(place // 2, url, "r") for place, url in enumerate(URLS + URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"] or "") for r in urls.judge(df, catalog.URL_RULES).collect()))
    assert got == sorted((key, *plain_judge(url, catalog.URL_RULES)[:2], plain_judge(url, catalog.URL_RULES)[2] or "") for key, url, _ in rows)


def test_url_query(spark, sf):
    pages = dict(map(tuple, catalog.table(spark, sf, "pages").select("page_id", "url").collect()))
    got = catalog.op13_url_filter(spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        host, path, rule, verdict = plain_judge(pages[row["page_id"]], catalog.URL_RULES)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if rule else row["verdict"] == ("block" if row["score"] >= 0.5 else "allow")


def test_trees_learn_from_labels(spark):
    """Held-out accuracy: junk has many digits and parameters, or stands under a suffix of its own; hosts are not shared."""
    rnd = random.Random(5)

    def name(letters: str, size: int) -> str:
        return "".join(rnd.choice(letters) for _ in range(size))

    rows = []
    for place in range(3000):
        bad = place % 3 == 0
        if bad and place % 2:
            url = f"http://{name('abc0123456789', 18)}.example/{name('0123456789', 20)}?{name('ab', 3)}={name('0123456789', 9)}&x={place}"
        elif bad:
            url = f"http://{name('abcdefgh', 7)}.junk/{name('abcdefgh', 6)}/{place % 7}.html"
        else:
            url = f"http://{name('abcdefgh', 7)}.example/{name('abcdefgh', 6)}/{place % 7}.html"
        rows.append((place, url, int(bad), None if place % 5 == 0 else int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, truth int, label int")
    got = urls.judge(df, [], label="label").join(df.select("page_id", "truth", "label"), "page_id").where("label is null")
    right, total = got.agg(F.sum(((F.col("verdict") == "block").cast("int") == F.col("truth")).cast("int")), F.count("*")).first()
    assert total == 600 and right / total >= 0.97
    few = urls.judge(df, [], label="label", settings=urls.Settings(max_rows=400, trees=5)).join(df.select("page_id", "truth"), "page_id")
    assert few.where((F.col("verdict") == "block").cast("int") == F.col("truth")).count() >= 0.95 * 3000


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.b/"), (None, None)], "page_id long, url string")
    assert {row["verdict"] for row in urls.judge(df, []).collect()} == {"allow"}
    blocked = urls.judge(df, [urls.Rule("b", "", "block")]).collect()
    assert {(row["page_id"], row["verdict"], row["rule"]) for row in blocked} == {(1, "block", "b"), (None, "block", None)}
    assert urls.judge(df.limit(0), catalog.URL_RULES).collect() == []
