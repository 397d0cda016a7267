"""Quality rules as a bitmask ledger.

Every rule is evaluated once: one pass over the texts measures them, then each rule is a comparison
of measurements whose failure sets one bit of ``fail_bits``.  The ledger (measurements and bits) can
be stored; a policy is a versioned mask of the rules that reject, so a new policy, or leaving one rule
out, is a bitwise operation on the ledger and never a second pass over texts.

Rules compare counts by whole-number arithmetic, so that SQL gives the same verdicts.  Cases: null
text has no words and fails ``few_words``; empty and repeated rows are measured one by one; texts of any
length are measured whole; an empty table gives an empty ledger; nothing is ranked, so there are no ties; input
columns named as an added one (in any case) are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import pieces as P
from strata.llm.common import map_text

SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_exclaims")

#: (rule, condition under which a text fails it), in the order of the bits; only ever add at the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("capitals", "10 * n_upper > 3 * (n_upper + n_lower)"),
    ("exclamations", "2 * n_exclaims > n_words"),
    ("low_diversity", "20 * n_distinct_words < n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "capitals", "exclamations"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask(policy: str, without: str | None = None) -> int:
    return sum(BIT[r] for r in POLICIES[policy] if r != without)


def _repeat_words(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each text, the words in 5-word windows that occur twice or more in it."""
    n = len(hashes)
    out = np.zeros(len(before) - 1, np.int64)
    if n < 6:
        return out
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    windows = P.ngram_hashes(hashes, 5)
    inside = doc[:n - 4] == doc[4:]
    at = np.flatnonzero(inside)
    key = P.mix(windows[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at[again], 1)
    np.add.at(edges, at[again] + 5, -1)
    covered = np.cumsum(edges[:n]) > 0
    return np.add.reduceat(np.append(covered, False).astype(np.int64), before[:-1]) * (np.diff(before) > 0)


def measure(texts: list[str], _: pa.Array | None = None) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    cp, offsets = P.codepoints(texts)
    starts, lengths, before = P.word_spans(cp, offsets)
    hashes = P.span_hashes(cp, starts, lengths)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    chars = np.concatenate([[0], np.cumsum(lengths)])
    pairs = np.unique(P.mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
    n_lines, n_dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            n_lines[k] = len(lines)
            n_dup[k] = len(lines) - len(set(lines))
        else:
            n_lines[k] = before[k + 1] > before[k]
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    small = np.minimum(cp, 127)
    return {
        "n_words": np.diff(before), "word_chars": np.diff(chars[before]), "n_symbols": total(symbol[small]),
        "n_dup_lines": n_dup, "n_repeat_words": _repeat_words(hashes, before), "n_lines": n_lines,
        "n_distinct_words": np.bincount(doc[pairs], minlength=len(texts)),
        "n_upper": total((cp >= 65) & (cp <= 90)), "n_lower": total((cp >= 97) & (cp <= 122)), "n_exclaims": total(cp == 33),
    }


def fail_bits() -> Column:
    """The rules that fail, over the measurement columns."""
    bits = F.lit(0).cast("bigint")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those named in ``keep``) with the measurements and ``fail_bits``."""
    schema = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() != "fail_bits"]
    return map_text(docs, measure, schema, text_col, tuple(names)).withColumn("fail_bits", fail_bits())


def passes(policy: str = CURRENT, without: str | None = None) -> Column:
    """True where a policy keeps the row of a ledger; ``without`` leaves one rule out."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, without)).cast("bigint")) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without) for each policy and rule of a ledger.

    The ledger is counted by failure pattern (2 ** rules at most) with map-side combine; everything
    else is bitwise work on those few rows.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("bigint").alias("all"), F.lit(BIT[r]).cast("bigint").alias("bit")) for p, rules in POLICIES.items() for r in rules]
    each = patterns.withColumn("case", F.explode(F.array(*cases))).select("fail_bits", "n", "case.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("all"))
    add = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        add(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), add(failed == F.col("bit")).alias("n_only"), add(failed == 0).alias("n_kept"),
        add((failed == 0) | (failed == F.col("bit"))).alias("n_kept_without"))


def keep_clean(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the columns of ``docs``, which stand under numbers while the
    ledger's columns are there, so that no names clash."""
    names = docs.columns
    inner = docs.toDF(*[f"__{k}" for k in range(len(names))])
    return ledger(inner, f"__{names.index(text_col)}").where(passes(policy)).select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(names)])


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN rep USING (doc_id, g)) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lin.dup, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lin.n, 0)::BIGINT AS n_lines, len(list_distinct(ws))::BIGINT AS n_distinct_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
  length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lin USING (doc_id)),
f AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (10 * n_dup_lines > 4 * n_lines)::INT + 16 * (10 * n_upper > 3 * (n_upper + n_lower))::INT + 32 * (2 * n_exclaims > n_words)::INT
  + 64 * (20 * n_distinct_words < n_words)::INT + 128 * (word_chars > 25 * n_words)::INT + 256 * (word_chars < 2 * n_words)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  fail_bits = 0 AS kept, fail_bits FROM f
"""
