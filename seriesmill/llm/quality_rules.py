"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over its bits.

``ledger`` measures each text and stores one bit per failed rule. A policy is a named, versioned set of rules;
applying it, comparing policies and ablations work on the bits alone and never read a text again.

Defined results: a null or empty text has no words, all measures are 0 and it fails ``few_words``. Repeated rows are
judged one by one. A null id is carried. Columns beside ``doc_id`` and ``text`` are not read, so none can clash.
An empty table gives an empty result. Text length is not limited: all work is linear or n log n per text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

# rule -> SQL predicate over the measures that is true for a failing text; the place in the list is the bit
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 4 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named version of which rules reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(RULES))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id`` and the measures of every text; with ``whole`` also the row itself as the struct ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(F.col(text_col)).alias("w"), *row)
    row = ["row"] if whole else []
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("w")
    windows = F.when(
        n >= 3,
        F.transform(
            F.slice("w", F.lit(1), n - 2),
            lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1), F.lit(" "), F.get("w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("g"),
        *row,
    )
    # windows next to their equals once sorted; only texts that hold an equal pair are sorted
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    df = df.withColumn(
        "s", F.when(repeats, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("p")))))
    )
    twice = F.filter("s", lambda e, i: (F.get("s", i - 1)["g"] == e["g"]) | (F.get("s", i + 1)["g"] == e["g"]))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["p"])))
    gaps = F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), *row,
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The measures and ``failed_bits``: bit k is set when the k-th rule of ``RULES`` fails."""
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured(docs, id_col, text_col, whole).withColumn("failed_bits", total.cast("long"))


def fails(policy: Policy, bits: Column | str = "failed_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def verdicts(entries: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """One boolean column ``<policy>_v<version>`` per policy: does it keep the document."""
    return entries.withColumns({f"{p.name}_v{p.version}": ~fails(p) for p in policies})


def kept_rows(docs: DataFrame, policy: Policy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns.

    The row number keeps the optimizer from copying the measures into the filter, where they would run many times.
    """
    entries = ledger(docs, id_col, text_col, whole=True).withColumn("nth", F.monotonically_increasing_id())
    return entries.filter(~fails(policy) & (F.col("nth") >= 0)).select("row.*")


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay if it is left out.

    The ledger shrinks to one row per distinct bitmask (two to the number of rules at most) before any policy is
    looked at.
    """
    counts = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    names, mask = list(RULES), policy.mask
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = counts.select("failed_bits", "n", F.inline(rules))
    rejected = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fail_it"),
        F.sum(F.when(rejected == F.col("bit"), F.col("n")).otherwise(0)).alias("only_it_rejects"),
        F.sum(F.when(rejected.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without_it"),
    )


def seen_bits(entries: DataFrame, by: str) -> DataFrame:
    """Per group: rules that some document fails and rules that all fail, by bitwise aggregation."""
    return entries.groupBy(by).agg(F.bit_or("failed_bits").alias("any_fails"), F.bit_and("failed_bits").alias("all_fail"))
