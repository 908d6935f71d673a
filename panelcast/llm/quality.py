"""Quality rules: a table of thresholds compiled into projections of length, symbol, stop-word and line ratios.

Only built-in functions: no user code runs, no rows move, and each text is read once. Arrays that several metrics
need are made once per row, each in a projection of its own (``once``), since Spark would otherwise copy their
expressions into every use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was we were with you "
    "au aux avec ce dans des du elle en est et il la le les mais ne nous ou par pas pour que qui se son sur un une vous "
    "auf aus bei das dem den der die ein eine einer er es für ich ist mit nicht sich sie und von war werden wie zu zum "
    "al con como del el esta este las lo los más no para pero por sin su sus una y"
).split()

#: White space, symbols and dashes as the patterns need them.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD_IN_LINE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``metric`` lies below ``low`` or above ``high``. A null metric never rejects."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value, tests = F.col(f"`{self.metric}`"), []
        if self.low is not None:
            tests.append(value < F.lit(self.low))
        if self.high is not None:
            tests.append(value > F.lit(self.high))
        test = tests[0]
        for other in tests[1:]:
            test = test | other
        return F.coalesce(test, F.lit(False))


#: Rejected in any case: too short, or mostly repeated three-word windows.
BASE = (
    Rule("too_short", "n_words", low=50),
    Rule("repetitive", "repeat_percent", high=50.0),
)
#: The method's thresholds (after Rae and others 2021), wide enough for clean prose in the languages of the stop words.
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns that are evaluated once per row however often they are used after."""
    value = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(value)))


def numbered(names: list[str]) -> list[Column]:
    """Columns under numbers instead of names, so that nothing made on the way can clash with them."""
    return [F.col(f"`{name}`").alias(f"_c{place}") for place, name in enumerate(names)]


def named(names: list[str], **replaced: Column) -> list[Column]:
    """The columns of ``numbered`` under their names again, some of them replaced."""
    return [replaced.get(name, F.col(f"_c{place}")).alias(name) for place, name in enumerate(names)]


def pairs(items: Column, step: int = 1) -> tuple[Column, Column]:
    """Items without the last ``step``, and without the first ``step``."""
    size = F.greatest(F.size(items) - step, F.lit(0))
    return F.slice(items, F.lit(1), size), F.slice(items, F.lit(1 + step), size)


def measured(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one struct column ``_q`` of counts. ``df`` must hold no other column that begins with ``_q``."""
    content = F.btrim(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(SPACE))
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = once(
        df,
        _q_words=F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(content, SPACES)),
        _q_lines=F.filter(F.split(raw, "\n"), lambda line: line.rlike(WORD_IN_LINE)),
        _q_symbols=F.length(raw) - F.length(F.regexp_replace(raw, SYMBOLS, "")),
    )
    words, lines = F.col("_q_words"), F.col("_q_lines")
    windows = F.greatest(F.size(words) - 2, F.lit(0))
    threes = F.transform(
        F.arrays_zip(*[F.slice(words, F.lit(first), windows).alias(name) for first, name in ((1, "a"), (2, "b"), (3, "c"))]),
        lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
    )
    df = once(
        df.withColumn("_q_n_words", F.size(words).cast("bigint")),
        _q_hashes=threes,
        _q_word_chars=F.length(F.array_join(words, "")).cast("bigint"),
        _q_stops=F.size(F.filter(words, lambda word: F.lower(word).isin(STOP_WORDS))).cast("bigint"),
        _q_n_lines=F.size(lines).cast("bigint"),
        _q_dups=(F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    ).drop("_q_words", "_q_lines")
    # Windows by hash, then place: equal windows are neighbours.
    df = once(df, _q_sorted=F.array_sort(F.transform(F.col("_q_hashes"), lambda hash_, place: F.struct(hash_.alias("h"), place.alias("p")))))
    first, second = pairs(F.col("_q_sorted"))
    equal = F.filter(F.arrays_zip(first.alias("l"), second.alias("r")), lambda two: two["l"]["h"] == two["r"]["h"])
    df = once(df.drop("_q_hashes"), _q_equal=equal).drop("_q_sorted")
    places = F.array_sort(
        F.array_distinct(
            F.concat(F.transform(F.col("_q_equal"), lambda two: two["l"]["p"]), F.transform(F.col("_q_equal"), lambda two: two["r"]["p"]))
        )
    )
    df = once(df, _q_places=places).drop("_q_equal")
    here, there = pairs(F.col("_q_places"))
    covered = F.aggregate(
        F.arrays_zip(here.alias("a"), there.alias("b")), F.lit(0).cast("bigint"), lambda sum_, two: sum_ + F.least(F.lit(3), two["b"] - two["a"])
    )
    repeated = F.when(F.size("_q_places") > 0, covered + F.lit(3)).otherwise(F.lit(0)).cast("bigint")
    whole = F.struct(
        F.col("_q_n_words").alias("n_words"), F.col("_q_word_chars").alias("word_chars"), F.col("_q_symbols").cast("bigint").alias("n_symbols"),
        F.col("_q_dups").alias("n_dup_lines"), repeated.alias("n_repeat_words"), F.col("_q_stops").alias("n_stop_words"), F.col("_q_n_lines").alias("n_lines"),
    )
    return df.withColumn("_q", whole).drop("_q_n_words", "_q_word_chars", "_q_symbols", "_q_dups", "_q_places", "_q_stops", "_q_n_lines")


def verdicts(base: tuple[Rule, ...], rules: tuple[Rule, ...]) -> list[Column]:
    """The columns compiled from the threshold tables: ``base_failed``, ``failed_rules`` (names in order) and ``kept``."""
    names = [F.when(rule.failed(), F.lit(rule.name)) for rule in (*base, *rules)]
    failed = F.filter(F.array(*names), lambda name: name.isNotNull())
    any_base = F.lit(False)
    for rule in base:
        any_base = any_base | rule.failed()
    any_rule = any_base
    for rule in rules:
        any_rule = any_rule | rule.failed()
    return [any_base.alias("base_failed"), failed.alias("failed_rules"), (~any_rule).alias("kept")]


#: Ratios of the counts; null where there is nothing to divide by.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words", 1.0),
    "symbol_ratio": ("n_symbols", "word_chars", 1.0),
    "stop_ratio": ("n_stop_words", "n_words", 1.0),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1.0),
    "repeat_percent": ("n_repeat_words", "n_words", 100.0),
}

REPORT = "quality"


def judge(df: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, into: str = REPORT) -> DataFrame:
    """Append a struct column ``into``: counts, ratios, ``base_failed``, ``failed_rules`` and ``kept``.

    Counts: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words`` (words inside three-word windows that occur twice or more in the text),
    ``n_stop_words``, ``n_lines`` (lines with a word). Null and empty texts have no words, so they are too short. A
    column already named ``into`` is replaced; every other column and every row stays as it is.
    """
    original = [name for name in df.columns if name != into]
    packed = df.select(*numbered(original), F.col(f"`{text}`").alias("_q_text"))
    kept = packed.columns[:-1]
    counted = measured(packed, "_q_text").select(*kept, "_q.*")
    ratios = {name: F.when(F.col(below) > 0, F.lit(scale) * F.col(above) / F.col(below)) for name, (above, below, scale) in RATIOS.items()}
    rated = counted.withColumns(ratios)
    judged = rated.select("*", *verdicts(base, rules))
    report = F.struct(*judged.columns[len(kept) :]).alias(into)
    return judged.select(*named(original), report)


#: DuckDB SQL for the query: the same counts and thresholds.
ORACLE = rf"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words)
), repeated AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id
), counts AS (
    SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{word}'" for word in STOP_WORDS)}))) AS n_stop_words
    FROM words LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
        OR coalesce(word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words, false)
        OR (word_chars > 0 AND n_symbols / word_chars > 0.05)
        OR (n_words > 0 AND n_stop_words / n_words < 0.02)
        OR (n_lines > 0 AND n_dup_lines / n_lines > 0.5)) AS kept
FROM counts
"""
