"""Quality rules: a ledger of failure bits per document, judged by versioned policies.

Every rule is evaluated once and leaves one bit; the measurements stay beside it. A policy is a
mask over the bits, so a new policy, or one without a rule, needs no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.names import without
from siftwork.llm.text_stats import with_counts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_same_words")
#: name -> condition of failing, over whole numbers; the place in this list is the rule's bit.
RULES: dict[str, str] = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines + 1",
    "upper_case": "2 * n_upper > n_chars",
    "same_words": "3 * n_same_words > n_words",
}
BASE = ("short", "repeats")
#: Policies by version; a version never changes.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) of `docs(text)`, MEASURES and `failed`, the rules' bits.

    A null or empty text has no words and fails as short. Every row has its row in the ledger,
    repeated rows too; an empty table gives none. A column of `keep` that is named like a measure or
    `failed`, in any case, gives way to the ledger's.
    """
    counted = with_counts(docs, "text", MEASURES, keep=without(["doc_id"] if keep is None else keep, [*MEASURES, "failed"]))
    bits: Column = F.lit(0)
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)))
    return counted.withColumn("failed", bits)


def passes(policy: tuple[str, ...]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger_rows: DataFrame, policy: tuple[str, ...]) -> DataFrame:
    """(rule, fails, alone): rows that break each rule of a policy, and rows that only this rule rejects.

    Rows are first counted by their bits, of which there are at most 2^rules combinations.
    """
    seen = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    per_rule = [F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in policy]
    each = seen.withColumn("r", F.explode(F.array(*per_rule)))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("fails"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("alone")
    )
