"""Quality rules as a bitmask ledger (operator 10).

Every rule is evaluated once per document: ``ledger`` stores the measurements and one bit
per failed rule. A policy is a named, versioned set of rules, so keeping, comparing
policies and ablations are bitwise work on the ledger and never read a text again.

Defined cases: a null or empty text has no words, every measurement 0 and fails
``few_words``; repeated rows are measured one by one; an empty table gives an empty
ledger; an input column named like a ledger column gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from gleaner.llm.common import map_columns
from gleaner.llm.textarrays import NOT_SPACE, POINT, Texts, byte_table, grams, keyed, seen_before, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")
_SYMBOL = byte_table("#*$%&|<>")
_UPPER = byte_table("", ((65, 90),))
_LETTER = byte_table("", ((65, 90), (97, 122)))

#: Bit i of the ledger is rule i. A rule holds (fails the document) over integer measures.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 60 * n_letters",
}
BASE = ("few_words", "repeat_words")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def measure(t: Texts) -> dict[str, np.ndarray]:
    """The measurements of a slice of texts."""
    n = len(t)
    start, end, text = t.segments(NOT_SPACE)
    repeats = np.zeros(len(start), bool)
    at, h = grams(t.hashes(start, end), text, (0, 1, 2))
    if len(at):
        keys = keyed(text[at], h)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        often = at[order[same[1:] | same[:-1]]]
        for d in range(3):
            repeats[often + d] = True
    ls, le, lt = t.lines()
    inked = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(NOT_SPACE[t.data], out=inked[1:])
    worded = inked[le] > inked[ls]
    ls, le, lt = ls[worded], le[worded], lt[worded]
    again = seen_before(keyed(lt, t.hashes(ls, le))) > 0
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": t.counts(NOT_SPACE & POINT),
        "n_symbols": t.counts(_SYMBOL),
        "n_lines": np.bincount(lt, minlength=n),
        "n_dup_lines": np.bincount(lt[again], minlength=n),
        "n_repeat_words": np.bincount(text[repeats], minlength=n),
        "n_upper": t.counts(_UPPER),
        "n_letters": t.counts(_LETTER),
    }


def failed(rule: str) -> Column:
    return F.expr(RULES[rule])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``fail_bits``; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = [measure(t) for t in slices(batch.column("text"))]
        return {m: pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64()) for m in MEASURES}

    measured = map_columns(docs, run, [StructField(m, LongType()) for m in MEASURES], keep, ["text"])
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed(rule), F.lit(1 << i)).otherwise(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str, bits: Column | None = None) -> Column:
    b = F.col("fail_bits") if bits is None else bits
    return b.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it fails, and those only it fails.

    The ledger is first aggregated by its bits (at most 2**rules groups), then bit by bit.
    """
    used = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    by_bits = led.groupBy(used.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    return (
        by_bits.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns from the ledger under policy ``v1``."""
    return ledger(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        passes("v1").alias("kept"),
        "fail_bits",
    )


def keep_passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in names.items()], F.col("text"))
    led = ledger(renamed, keep=tuple(names.values()))
    return led.filter(passes(policy)).select(*[F.col(h).alias(c) for c, h in names.items()])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
g3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g2),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY rid),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN l2 USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars > 20 * n_words)::INT
  + 8 * (word_chars < 2 * n_words)::INT + 16 * (2 * n_symbols > n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
  + 64 * (100 * n_upper > 60 * n_letters)::INT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""
