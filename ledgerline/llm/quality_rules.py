"""Quality rules as a short-circuit cascade: the rule that rejects most per second of work is tried first.

All DataFrame expressions; nothing leaves the JVM, and nothing but the sample's timings comes to the driver.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.runtime import settle

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
# About how many rows the order of the rules is estimated on, and how long a rule is repeated on them at least. Both decide the order
# alone, never a verdict.
SAMPLE_ROWS = 1000
LEAST_SECONDS = 0.1
FEW_REPEATS, MOST_REPEATS = 1, 256
MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")


@dataclass(frozen=True)
class Rule:
    """A name and the condition under which a row is rejected; a condition that is null does not reject."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    """What a rule takes for a row, in seconds, and the share of the sample's rows that it rejects."""

    rule: Rule
    seconds: float
    share: float

    @property
    def worth(self) -> float:
        return self.share / self.seconds


def estimates(sample: DataFrame, rules: list[Rule], least_seconds: float = LEAST_SECONDS) -> list[Estimate]:
    """Each rule's cost and selectivity on the sample's rows.

    One job evaluates a rule on every row, again and again: there are more repeats until the job takes ``least_seconds``
    more than the same job without the rule, so that starting a job weighs little. A rule that hits no row of the sample counts as
    one that hits half a row.
    """

    def timed(condition: Column, repeats: int) -> tuple[float, int, int]:
        again = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        took = []
        # The first run compiles.
        for _ in range(2):
            start = time.perf_counter()
            row = again.agg(F.count_if(condition).alias("hit"), F.count("*").alias("n")).first()
            took.append(time.perf_counter() - start)
        return min(took), row.hit // repeats, row.n // repeats

    out = []
    empty: dict[int, float] = {}
    for rule in rules:
        repeats = FEW_REPEATS
        while True:
            if repeats not in empty:
                empty[repeats] = timed(F.col("__again") < 0, repeats)[0]
            took, hit, n = timed(rule.rejects, repeats)
            extra = took - empty[repeats]
            if extra >= least_seconds or repeats >= MOST_REPEATS or not n:
                break
            repeats *= 16
        out.append(Estimate(rule, max(extra, 1e-3) / max(n * repeats, 1), (hit + 0.5) / (n + 1)))
    return out


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """About ``rows`` rows drawn from the whole table, written once."""
    count = docs.count()
    return settle(docs if count <= rows else docs.sample(min(1.0, rows / count), seed), "rule-sample")


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """The rules by rejections per second, the best first."""
    return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. A branch is evaluated only if none before it rejected."""
    first, *rest = rules
    found = F.when(first.rejects, F.lit(first.name))
    for rule in rest:
        found = found.when(rule.rejects, F.lit(rule.name))
    return found


def word_list(text: str) -> Column:
    """Words of a text (runs of other characters than space, tab and \\n \\v \\f \\r); a null text has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")


def line_list(text: str) -> Column:
    """Lines that hold a word; a null text has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _keys(words: Column) -> Column:
    """A 64-bit hash of every window of WINDOW words, in order."""
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(n >= WINDOW, window).otherwise(F.expr("cast(array() as array<bigint>)"))


def _covered(keys: Column) -> Column:
    """Words in windows whose hash occurs again: equal windows stand together once sorted; their places are then merged in order."""
    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.element_at(
        F.transform(
            F.array(pairs),
            lambda s: F.element_at(
                F.transform(
                    F.array(F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(x.k == F.get(s, i - 1).k, F.lit(False)) | F.coalesce(x.k == F.get(s, i + 1).k, F.lit(False))), lambda x: x.i))),
                    lambda at: F.aggregate(
                        F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                        F.lit(0).cast("long"),
                        lambda total, x: total + x,
                    ),
                ),
                1,
            ),
        ),
        1,
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and ``__words`` for further rules.

    word_chars counts code points in words, n_symbols the characters # * $ % & | < >, n_dup_lines lines with a word that equal an
    earlier line, n_repeat_words the words in windows of five that occur twice or more in the text, the first time included. Null
    and empty texts have zero of everything. Repeated windows are told by a 64-bit hash within one text; only a text that has any
    is sorted.
    """
    # Columns that are named like a measure give way to it; the text is kept apart, whatever its name.
    columns = [c for c in docs.columns if c.lower() not in MADE and c != "__text"]
    docs = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    text = "__text"
    columns.append(text)
    # A generator of one row after each step: the optimiser neither copies a step's expression into the next nor moves a filter
    # below it, so each text is split, hashed and measured once.
    split = docs.select(*columns, F.inline(F.array(F.struct(word_list(text).alias("__words"), line_list(text).alias("__lines")))))
    keyed = split.select(*columns, "__words", "__lines", F.explode(F.array(_keys(F.col("__words")))).alias("__keys"))
    again = F.size("__keys") > F.size(F.array_distinct("__keys"))
    measures = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, _covered(F.col("__keys"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return keyed.select(*columns, "__words", F.inline(F.array(measures)))


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def rules(text: str = "text") -> list[Rule]:
    """The rules beyond the base: symbols, word length, repeated lines, capitals, words that stutter, links, words without a letter."""
    # The first three compare measures; the others read the text or its words, and only in their branch of the cascade.
    letters, capitals = F.regexp_count(F.col(text), F.lit(r"\p{L}")), F.regexp_count(F.col(text), F.lit(r"\p{Lu}"))
    words = F.col("__words")
    stutters = F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False))))
    return [
        Rule("symbols", F.expr("10 * n_symbols > n_words")),
        Rule("word_length", F.expr("word_chars < 3 * n_words or word_chars > 10 * n_words")),
        Rule("repeated_lines", F.expr("10 * n_dup_lines > 4 * n_lines")),
        Rule("capitals", 2 * capitals > letters),
        Rule("stutter", 10 * stutters > 3 * F.col("n_words")),
        Rule("links", 5 * F.regexp_count(F.col(text), F.lit("(?i)https?://")) > F.col("n_words")),
        Rule("letterless", 2 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) < F.col("n_words")),
    ]


def judge(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with the measures, base_failed, rejected_by and kept.

    The base comes first: fewer than ten words, or over a fifth of them in repeated windows. The other rules follow in the order of
    rejections per second that a sample of those that pass the base shows; a row leaves the cascade at its first rejection.
    ``kept`` does not depend on the order, ``rejected_by`` may. Columns of ``docs`` that are named like a new one (MADE) are replaced.
    Null and empty texts fail the base; repeated rows are judged alike;
    an empty table gives an empty one.
    """
    sample = settle(measured(sampled(docs, sample_rows), text).where(~base_failed()), "rule-measures")
    order = ordered(estimates(sample, rules("__text")))
    judged = measured(docs, text).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("__words", "__text")
