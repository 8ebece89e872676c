"""Quality rules: a table of thresholds compiled into one Spark projection.

No user function runs: counts are built-in and higher-order functions over the words and lines of a text, each
computed once a row, and every rule is a comparison of two of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as with was be by on are or an this from at not have which but",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son",
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya",
)


@dataclass(frozen=True)
class Rule:
    """A text passes where ``low <= over / under <= high``; either bound may be open. Ratios of nothing are 0."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.04, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.50),
    Rule("mark_ratio", "n_marks", "n_words", None, 0.30),
)


def _repeated_words(words_: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first place included.

    The windows' 64-bit hashes are sorted with their places, so a text of n words costs n log n; texts without a
    repeated hash, which a set shows, stop before the sort.
    """

    def covered(ordered: Column) -> Column:
        same = lambda i, k: (i + k >= 0) & (i + k < F.size(ordered)) & (F.get(ordered, i + k)["h"] == F.get(ordered, i)["h"])
        hits = F.filter(ordered, lambda x, i: same(i, -1) | same(i, 1))
        places = F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + (width - 1))))
        return F.size(F.array_distinct(places)).cast("long")

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), covered)
            ),
        )

    return F.when(F.size(words_) <= width, F.lit(0).cast("long")).otherwise(windows(words_))


def measures(text: Column) -> dict[str, Column]:
    """The counts that rules may name. Every one is 0 for a null or empty text."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
        ),
    )
    by_lines = let(found, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    gone = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    return {
        "by_words": by_words,
        "by_lines": by_lines,
        "word_chars": F.length(F.regexp_replace(text, SEPARATORS, "")).cast("long"),
        "n_symbols": gone(r"[#*$%&|<>]+"),
        "n_marks": gone(r"[!?]+"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one boolean expression over the columns of ``measures``."""
    out = F.lit(True)
    for r in rules:
        x = F.when(F.col(r.under) > 0, F.col(r.over) / F.col(r.under)).otherwise(F.lit(0.0))
        if r.low is not None:
            out &= x >= F.lit(float(r.low))
        if r.high is not None:
            out &= x <= F.lit(float(r.high))
    return out


def with_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; the result's own columns replace any of these names.

    ``base_failed``: under 50 words, or more than half of the words lie in repeated 3-word windows. ``kept``: not
    base_failed and every rule holds. A null text counts as an empty one, so it fails. Rows are independent, hence
    repeated rows get the same verdict each; an empty table gives an empty result.
    """
    m = measures(F.col(text))
    own = ("by_words", "by_lines", "word_chars", "n_symbols", "n_marks")
    counts = docs.select("*", F.struct(*[m[k].alias(k) for k in own]).alias("__m"))
    flat = {k: F.col("__m")[k] for k in own[2:]}
    flat |= {k: F.col("__m")["by_words"][k] for k in ("n_words", "n_repeat_words", "n_stop_words")}
    flat |= {k: F.col("__m")["by_lines"][k] for k in ("n_lines", "n_dup_lines")}
    out = counts.withColumns(flat).drop("__m")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return with_rules(docs.select(F.struct(*own).alias("__row"), F.col(text).alias("__text")), rules, "__text").filter("kept").select("__row.*")
