"""Quality rules as a short-circuit cascade, ordered by rejections per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored, words

WINDOW = 8
SAMPLE = 500      # rows on which cost and selectivity are estimated; they decide the order only, never a verdict
REPEAT = 16       # times each sample row is evaluated, so that a rule's time stands out from a job's


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(found: Column) -> Column:
    """Words that lie in a window of 8 words that occurs twice or more in the text.

    Windows are compared by 64-bit hashes. Texts without a repeated window end after one distinct count; in others
    the hashes are sorted with their places, and the places of equal neighbours are measured as intervals.
    """
    place = lambda i: i.cast("int")

    def twice(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda all_, s, k: F.try_element_at(all_, k)["g"] == s["g"]
        hits = bound(ordered, lambda o: F.filter(o, lambda s, k: ((k > 0) & F.coalesce(same(o, s, F.greatest(place(k), F.lit(1))), F.lit(False)))
                                                 | F.coalesce(same(o, s, place(k) + 2), F.lit(False))))
        starts = F.sort_array(F.transform(hits, lambda s: s["i"]))
        steps = bound(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(p, place(k) + 2) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def of(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), twice(g)).otherwise(F.lit(0).cast("bigint")))

    return F.when(F.size(found) <= WINDOW, F.lit(0).cast("bigint")).otherwise(bound(F.transform(found, lambda w: F.xxhash64(w)), of))


def base_measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    by_words = bound(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_lines = bound(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                               (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    rows = docs.select("doc_id", text.alias("text"), by_words.alias("w"), by_lines.alias("l"),
                       F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    failed = (F.col("w.n_words") < 20) | (100 * F.col("w.n_repeat_words") > 30 * F.col("w.n_words"))
    return rows.select("doc_id", "text", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines",
                       failed.alias("base_failed"))


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `rejects` holds; conditions read the measures above or the text itself."""

    name: str
    rejects: Column


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def standard_rules() -> list[Rule]:
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
        Rule("capitals", 2 * _count("\\p{Lu}") > _count("\\p{L}")),
        Rule("no_letters", 5 * _count("(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])") > F.col("n_words")),
        Rule("cut_lines", 10 * _count("(\\.\\.\\.|\\x{2026})[\\x20\\x09\\x0B-\\x0D]*(\\n|$(?![\\n]))") > 3 * F.col("n_lines")),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    share: float

    @property
    def worth(self) -> float:
        """Rejections per second."""
        return self.share / self.seconds


def estimate(rows: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Cost and share of rejections of each rule on stored sample rows, the best worth first.

    A rule's cost is the least time of two runs over the sample beyond that of an empty rule.
    """
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def run(rule: Column) -> tuple[float, float]:
        taken = []
        for _ in range(2):
            begun = time.perf_counter()
            share = rows.agg(F.avg(F.coalesce(rule, F.lit(False)).cast("int")).alias("share")).first()["share"]
            taken.append(time.perf_counter() - begun)
        return min(taken), share or 0.0

    empty, _ = run(F.col("text").isNull())
    found = [Estimate(rule, max(run_[0] - empty, 1e-3), run_[1]) for rule in rules for run_ in [run(rule.rejects)]]
    return sorted(found, key=lambda e: (-e.worth, e.rule.name))


def sample_rows(docs: DataFrame) -> DataFrame:
    """The `SAMPLE` rows of least hash, over all partitions: doc_id, text. Only hashes go to the driver."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("doc_id", "text").alias("h"))
    last = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    # Repeated rows share a hash, so that more rows than SAMPLE can be below the last one.
    return rows.where(F.col("h") <= F.lit(last).cast("bigint")).limit(SAMPLE).drop("h")


def cascade(rules: list[Rule]) -> Column:
    """False at the first rule that rejects; later rules are not evaluated for that row. True where none does."""
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts are texts without words. The verdict is the same in every order of the rules; the order, cheapest
    rejections first, comes from a bounded sample. Repeated rows get equal results.
    """
    rules = standard_rules() if rules is None else rules
    docs = columns_of(docs, "doc_id", "text")
    few = stored(sample_rows(docs), "rules-rows")
    sample = stored(base_measures(few).where(~F.col("base_failed")), "rules-sample")
    ordered = [e.rule for e in estimate(sample, rules)]
    measured = base_measures(docs).withColumn("kept", cascade(ordered))
    return measured.select(F.col("doc_id").cast("bigint"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = "'[ \\t\\n\\x0B\\f\\r]+'"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, {_WORD}), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM d),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, CASE WHEN lead(i, 7) OVER o IS NOT NULL THEN list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS gram,
             word FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g),
c AS (SELECT r, max(twice::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM t),
n AS (SELECT r, sum(hit)::bigint AS n_repeat_words FROM c GROUP BY r),
m AS (SELECT d.doc_id, d.text, len(words)::bigint AS n_words, coalesce(length(array_to_string(words, '')), 0)::bigint AS word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
             len(lines) AS n_lines, len(list_filter(words, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) AS no_letters,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})[ \\t\\x0B\\f\\r]*$'))) AS cut
      FROM d JOIN w USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words
            OR 2 * length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) > length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))
            OR 5 * no_letters > n_words OR 10 * cut > 3 * n_lines) AS kept
FROM b"""
