"""Quality rules: a table of thresholds, compiled into one projection.

Every rule is a measure of a text and the range in which good texts lie. All
measures are Spark expressions over the text alone, so the rules run in one
pass beside the scan, without a shuffle and without user functions.

The rule on stop words is a policy on languages: texts of 100 words or more have
to hold some frequent words of English, German, French or Spanish.

Defined results: a null or empty text has no words, fails the base rule and is
not kept. Very long texts are read whole. Equal rows give equal results. An empty table gives an empty result.
Ratios of a text without words are null, and a rule on a null ratio passes; the
base rule rejects such texts already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, GAP_CHARS, whole_text, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # of the SQL
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that for it as was with be by on not he are this at from or an"
    " der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es"
    " de la le et les des en un du une que est pour qui dans par au il pas sur"
    " el y los se del las por con para su al lo como más".split()
)


@dataclass(frozen=True)
class Rule:
    """Texts whose measure lies outside [low, high] are rejected; from `of_words`
    words on only."""

    measure: str
    low: float | None = None
    high: float | None = None
    of_words: int = 0


#: Production thresholds.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0, MIN_WORDS),
    Rule("symbol_ratio", high=0.1),
    Rule("shout_ratio", high=0.3),
    Rule("upper_ratio", high=0.5),
    Rule("stop_ratio", low=0.01, of_words=100),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9, of_words=MIN_WORDS),
)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value computed once: the variable of a lambda over one element
    stays as it is when the optimizer moves or repeats an expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def window_hashes(w: Column, size: int = WINDOW) -> Column:
    """A hash of each window of `size` words: hashes of words are joined by
    threes, so that a window takes a few steps, not a slice of its words."""

    def joined(hashes: Column, near: int, far: int) -> Column:
        return bind(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + near), F.get(h, i + far))))

    out, length = F.transform(w, lambda x: F.xxhash64(x)), 1
    while length < size:
        new = min(3 * length, size)
        out, length = joined(out, min(length, new - length), new - length), new
    return F.slice(out, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))


def neighbours_equal(s: Column, field: str) -> Column:
    """Of sorted structs those that have the field of one beside them."""
    same = lambda i, j: F.get(s, i)[field] == F.get(s, j)[field]
    return F.filter(s, lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """Number of words that lie in a window of `size` words found twice or more
    in the text. A text whose window hashes all differ has none. In others,
    windows whose hash is repeated are written out and sorted with their places;
    one equal to a neighbour is repeated; each adds the words up to the next."""
    n = F.size(w) - (size - 1)

    def windows(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
        maybe = bind(at, lambda s: neighbours_equal(s, "h"))
        return F.sort_array(F.transform(maybe, lambda x: F.struct(F.array_join(F.slice(w, x["i"], size), " ").alias("w"), x["i"].alias("i"))))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(neighbours_equal(s, "w"), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(size)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(size), lambda a, b: a + b))

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(windows(h), lambda s: bind(places(s), covered)))
    return F.when(n < 2, F.lit(0)).otherwise(bind(window_hashes(w, size), counted)).cast("long")


def _counts(text: Column, w: Column, lines: Column) -> Column:
    n = lambda x: x.cast("long")
    counts = {
        "n_words": n(F.size(w)),
        "word_chars": n(F.length(F.array_join(w, ""))),
        "n_symbols": n(F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))),
        "n_dup_lines": n(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": repeated_words(w),
        "n_shouts": n(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))),
        "n_upper": n(F.regexp_count(text, F.lit("[A-Z]"))),
        "n_stop": n(F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS)))),
        "n_bullets": n(F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "|")))),
        "n_lines": n(F.size(lines)),
    }
    return F.struct(*(c.alias(k) for k, c in counts.items()))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_upper", "n_stop", "n_bullets", "n_lines")


def _verdict(m: Column, rules: tuple[Rule, ...]) -> Column:
    per = lambda k, of: m[k] / F.nullif(m[of], F.lit(0))
    measures = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "shout_ratio": per("n_shouts", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullets", "n_lines"),
    }

    def passes(rule: Rule) -> Column:
        x, ok = measures[rule.measure], F.lit(True)
        if rule.low is not None:
            ok &= x >= rule.low
        if rule.high is not None:
            ok &= x <= rule.high
        return F.coalesce(ok, F.lit(True)) | (m["n_words"] < rule.of_words)

    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
    broken = F.filter(F.array(*(F.when(~passes(r), F.lit(r.measure)) for r in rules)), lambda x: x.isNotNull())
    return bind(broken, lambda b: F.struct(*(m[k].alias(k) for k in COUNTS), *(x.alias(k) for k, x in measures.items()), failed.alias("base_failed"), b.alias("broken"), (~failed & (F.size(b) == 0)).alias("kept")))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All counts, measures and verdicts of a text, as one expression."""
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(GAP_CHARS)) != "")
    parts = lambda t: F.struct(words(t).alias("w"), lines(t).alias("l"))
    return bind(text, lambda t: bind(parts(t), lambda p: bind(_counts(t, p["w"], p["l"]), lambda m: _verdict(m, rules))))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the struct `quality`; other columns stay as they are."""
    return docs.withColumn("quality", verdict(whole_text(), rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, columns unchanged."""
    return docs.where(verdict(whole_text(), rules)["kept"])
