"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps the measurements and one bit
for each failed rule.  A policy is a versioned set of rules, so applying one, comparing
two, or asking what a rule alone rejects are bit operations over the ledger: the texts
are not read again.

Defined results: a null or empty text measures zero everywhere and fails ``few_words``;
repeated rows and null ids are kept as rows.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import flat
from loomery.llm.measures import NAMES, measure
from loomery.llm.util import map_batches

#: Rule -> the condition of failing it, over the measurements.  A rule's place is its bit; append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "10 * word_chars < 20 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "100 * n_letters < 50 * (n_chars + n_wide)",
    "one_word_over": "10 * n_distinct_words < n_words and n_words < 1000",
}

#: Policy version -> the rules that reject under it.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "few_letters"),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, failed): ``failed`` has bit i set where rule i fails."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [measure(chunk)[0] for chunk in flat.chunks(batch.column(1))]
            columns = [pa.array(np.concatenate([p[name] for p in parts]).astype(np.int64)) for name in NAMES]
            return pa.record_batch([batch.column(0), *columns], names=["id", *NAMES])

        return each

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{name} long" for name in NAMES)])
    measured = map_batches(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")), make, schema)
    failed = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.select(F.col("id").alias(key), *NAMES, failed.alias("failed"))


def rejected(policy: str, failed: str = "failed") -> Column:
    """True where the policy rejects the row."""
    return F.col(failed).bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    One row a rule (rule, failing, only_this, rejected); counts are summed map-side.
    """
    mask = F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    bits = {rule: 1 << bit for bit, rule in enumerate(RULES) if rule in POLICIES[policy]}
    sums = [F.count_if(mask != 0).alias("rejected")]
    for rule, bit in bits.items():
        sums += [F.count_if(mask.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"failing_{rule}")]
        sums += [F.count_if(mask == bit).alias(f"only_{rule}")]
    one = book.agg(*sums)
    return one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(rule).alias("rule"),
                        F.col(f"failing_{rule}").alias("failing"),
                        F.col(f"only_{rule}").alias("only_this"),
                        F.col("rejected"),
                    )
                    for rule in bits
                ]
            )
        ).alias("r")
    ).select("r.*")


def verdicts(book: DataFrame, policy: str = "v1", key: str = "doc_id") -> DataFrame:
    """The ledger's rows under a policy, with base_failed and kept."""
    return book.select(
        key, *NAMES[:5], rejected("base").alias("base_failed"), (~rejected(policy)).alias("kept"), "failed"
    )
