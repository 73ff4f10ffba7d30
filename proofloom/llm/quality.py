"""Quality rules as a short-circuit cascade, cheapest rejection first. Native."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, bind, discard, free_name, written

#: All but the symbols that are counted.
SYMBOLS = r"[^#*$%&|<>]+"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def _covered(hashes: Column) -> Column:
    """Words in the 5-word windows whose hash occurs twice or more; hashes has one entry a window."""

    def from_sorted(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        starts = F.array_sort(F.transform(at, lambda i: F.get(s, i)["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")))["n"]

    return bind(F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), from_sorted)


def repeat_words(words: Column) -> Column:
    """Number of words inside 5-word windows that occur twice or more in the list, the first included.

    Windows are compared by 64-bit hashes within one text. Texts without any repeat stop at a
    hash set of the windows; only the others are sorted.
    """
    of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    counted = bind(of(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(counted)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all over the whole text.

    A null or empty text has no words, symbols or lines: all five are 0. Columns of these names in docs are replaced; equal rows stay rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    both = bind(word_list(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    held, added = free_name(docs.columns, "m"), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    return docs.withColumn(held, both).select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        F.col(f"{held}.n").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        duplicate_lines(t).cast("long").alias("n_dup_lines"),
        F.col(f"{held}.r").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule rejects a document when `rejects`, a function of the text column, is true; it measures only what it needs itself."""

    name: str
    rejects: Callable[[Column], Column]


def _base(text: Column) -> Column:
    return bind(word_list(text), lambda w: (F.size(w) < 10) | (100 * repeat_words(w) > 20 * F.size(w)))


def _mean_length(text: Column) -> Column:
    both = F.struct(F.regexp_count(text, F.lit(WORD)).alias("n"), F.length(F.regexp_replace(text, SPACE, "")).alias("c"))
    return bind(both, lambda x: (x["c"] < 3 * x["n"]) | (x["c"] > 12 * x["n"]))


BASE = Rule("base", _base)
#: What production asks for beyond the base rule.
RULES = (
    Rule("mean_word_length", _mean_length),
    Rule("symbols", lambda t: 10 * F.length(F.regexp_replace(t, SYMBOLS, "")) > F.regexp_count(t, F.lit(WORD))),
    Rule("duplicate_lines", lambda t: duplicate_lines(t) >= 3),
    Rule("too_long", lambda t: F.regexp_count(t, F.lit(WORD)) > 100_000),
)


def ordered_rules(docs: DataFrame, text: str = "text", rules=(BASE, *RULES), sample_rows: int = 2000) -> list[tuple[Rule, float]]:
    """Rules by rejected share per second of evaluation, best first, on a sample of about sample_rows rows, drawn each by itself.

    The cost of a rule is the best of two runs over the stored sample, less that of a run that only reads it. The order changes the
    cost alone: a document stays when no rule rejects it. An empty table leaves the order as it is.
    """
    n = docs.count()
    some = docs.sample(sample_rows / n, seed=1) if n > sample_rows else docs
    sample = written(some.select(F.coalesce(F.col(text), F.lit("")).alias("t")), "sample")

    def timed(expr: Column) -> tuple[float, int]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(expr), F.count(F.lit(1))).first()
            took.append(time.perf_counter() - began)
        return min(took), hits

    idle, (_, rows) = timed(F.length("t") < 0)
    scored = []
    for rule in rules:
        took, (hits, _) = timed(rule.rejects(F.col("t")))
        scored.append((rule, hits / max(1, rows) / max(1e-3, took - idle)))
    discard(sample)
    return sorted(scored, key=lambda x: -x[1])


def cascade(docs: DataFrame, rules: list[Rule], text: str = "text", name: str = "rejected_by") -> DataFrame:
    """docs with the first rule that rejects the whole text (null: kept); a null text is empty. A column of that name is replaced.

    CASE stops at the first hit, so a rule's measures are taken only of texts that no earlier rule rejects.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    chain = reduce(lambda c, r: c.when(r.rejects(t), F.lit(r.name)), rules[1:], F.when(rules[0].rejects(t), F.lit(rules[0].name)))
    return docs.withColumn(name, chain)
