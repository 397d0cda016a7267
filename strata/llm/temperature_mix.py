"""Temperature mixing of sources, realised as budgeted block permutations.  DataFrame functions only.

A source's weight is its token share to the power ``exponent``, normalised.  The exponent is bisected
on a grid of 1 / GRID: the largest one that reaches a target entropy, raised, where needed, until no source
repeats more often than allowed.  Each step is one aggregation over the table of sources.

A source's quota is ``floor(weight * budget)`` tokens.  Its documents stand in the order of a seeded
hash (the permutation); whole passes are taken while they fit, then the documents up to a threshold hash,
within the rest of the quota.  The threshold is found block by block: the hash space of a source is cut
into equal blocks of about ``BLOCK_DOCS`` documents, block totals say in which block the quota ends, and
only that block is looked at document by document.  So no source is sorted in one task, however large,
and each document's ``copies`` follow from its own hash and one small row of its source.

Cases: null source is a source of its own; null text has no tokens; sources without tokens keep their
documents once; texts of any length are counted whole; repeated rows share a hash and are taken or left
together; an empty table gives an empty result; ``mix`` replaces an input column named as one it adds
(``ADDED``, in any case), ``realise`` keeps all columns and their values.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import materialise

GRID = 1024
BLOCK_DOCS = 1024
WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("mix_source", "mix_tokens", "mix_key", "mix_passes", "mix_threshold", "copies", "exponent")


@dataclass
class Target:
    """What the exponent is bisected for: an entropy, as a part of the largest possible one, and the
    most passes over a source.  The budget is given in tokens or as a share of all tokens; without one, it is
    the least that keeps all documents."""

    entropy: float | None = None
    max_repeats: float | None = None
    budget: int | None = None
    budget_share: float | None = None


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with source name (never null), token count and permutation key (hex)."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    return kept.withColumns({
        "mix_source": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")),
        "mix_tokens": word_count(F.col(text_col)),
        "mix_key": F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 15)})


def _at(exponents: list[int], sources: DataFrame, total: int) -> dict[int, tuple[float, float, float, int]]:
    """For each exponent (in grid steps): sum of powers, entropy, largest weight to share ratio, sources."""
    shares = sources.where("tokens > 0").withColumn("ls", F.log(F.col("tokens") / F.lit(total)))
    a = F.col("k") / GRID
    rows = shares.withColumn("k", F.explode(F.array(*[F.lit(k) for k in exponents]))).groupBy("k").agg(
        F.sum(F.exp(a * F.col("ls"))).alias("z"), F.sum(F.col("ls") * F.exp(a * F.col("ls"))).alias("u"), F.max(F.exp((a - 1) * F.col("ls"))).alias("top"), F.count("*").alias("n"))
    rows = rows.select("k", "z", (F.log("z") - F.col("k") / GRID * F.col("u") / F.col("z")).alias("h"), (F.col("top") / F.col("z")).alias("ratio"), "n")
    return {r["k"]: (r["z"], r["h"], r["ratio"], r["n"]) for r in rows.collect()}


def bisect(sources: DataFrame, target: Target, total: int) -> int:
    """The exponent, in grid steps from 0 (equal weights) to GRID (the sources' own shares)."""
    import math

    def flat_enough(v) -> bool:  # holds at small exponents
        return target.entropy is None or v[1] >= target.entropy * math.log(v[3]) - 1e-12

    def repeats(v, k) -> float:
        if target.budget is not None:
            return target.budget / total * v[2]
        return v[2] / least[k]

    least: dict[int, float] = {}

    def few_repeats(v, k) -> bool:  # holds at large exponents
        return target.max_repeats is None or repeats(v, k) <= target.max_repeats + 1e-12

    def section(holds_low: bool, test) -> int:
        """Bisection, several cuts a step: the last grid point of the side where ``test`` holds."""
        lo, hi = (0, GRID + 1) if holds_low else (-1, GRID)
        while hi - lo > 1:
            step = max(1, (hi - lo) // 16)
            cuts = [k for k in range(lo + step, hi, step) if 0 <= k <= GRID] or [lo + 1]
            values = _at(cuts, sources, total)
            least.update(_least(cuts, sources, values, total))
            for k in cuts:
                if test(values[k], k) == holds_low:
                    lo = k
                else:
                    hi = k
                    break
        return lo if holds_low else hi

    k = section(True, lambda v, k: flat_enough(v)) if target.entropy is not None else 0
    return max(k, section(False, few_repeats)) if target.max_repeats is not None else k


def _least(exponents: list[int], sources: DataFrame, values: dict, total: int) -> dict[int, float]:
    """For each exponent the smallest weight to share ratio, from which the keep-all budget follows."""
    share = F.col("tokens") / F.lit(total)
    top = sources.where("tokens > 0").agg(F.max(share).alias("s"), F.min(share).alias("t")).first()
    return {k: min(top["s"] ** (k / GRID - 1), top["t"] ** (k / GRID - 1)) / values[k][0] for k in exponents}


def plan(rows: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """One row per source (mix_source, passes, threshold) and the exponent, from keyed rows."""
    sources = materialise(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not total:
        return sources.select("mix_source", F.lit(1).cast("bigint").alias("passes"), F.lit("").alias("threshold")), 1.0
    if target.budget_share is not None:
        target = replace(target, budget=round(target.budget_share * total))
    k = bisect(sources, target, total)
    z, _, _, _ = _at([k], sources, total)[k]
    budget = target.budget
    if budget is None:
        budget = total / _least([k], sources, {k: (z,)}, total)[k]
    weight = F.exp(F.lit(k / GRID) * F.log(F.col("tokens") / F.lit(total))) / F.lit(z)
    # a millionth of a token forgives the rounding of the least budget
    quota = F.when(F.col("tokens") > 0, F.floor(weight * F.lit(float(budget)) + 1e-6)).otherwise(0)
    if target.budget is None:  # rounding never costs a document: the least budget holds all tokens of every source
        quota = F.greatest(quota, F.col("tokens"))
    quotas = sources.withColumn("quota", quota.cast("bigint")).withColumns({
        "passes": F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1).cast("bigint"),
        "rest": F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(0).cast("bigint"),
        "blocks": F.ceil(F.col("docs") / BLOCK_DOCS).cast("bigint")})
    quotas = materialise(quotas, "mix-quotas")
    block = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("bigint") * F.col("blocks") / F.lit(float(1 << 32))).cast("bigint")
    placed = rows.select("mix_source", "mix_key", "mix_tokens").join(quotas.select("mix_source", "rest", "blocks"), "mix_source").withColumn("block", block)
    totals = placed.groupBy("mix_source", "block").agg(F.sum("mix_tokens").alias("n"), F.first("rest").alias("rest"))
    along = Window.partitionBy("mix_source").orderBy("block")
    ends = totals.withColumn("upto", F.sum("n").over(along)).where("upto > rest").groupBy("mix_source").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("mix_source", F.col("e.block").alias("block"), "e.before")
    last = placed.join(ends, ["mix_source", "block"]).groupBy("mix_source", "block", "mix_key").agg(F.sum("mix_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    inside = Window.partitionBy("mix_source", "block").orderBy("mix_key")
    taken = last.withColumn("upto", F.col("before") + F.sum("n").over(inside)).where("upto <= rest").groupBy("mix_source").agg(F.max("mix_key").alias("taken"))
    # a hash below the block's first one if the block holds nothing that fits
    first = F.lpad(F.hex(F.ceil(F.col("block") * F.lit(float(1 << 32)) / F.col("blocks")).cast("bigint")), 8, "0")
    edge = quotas.join(ends, "mix_source", "left").join(taken, "mix_source", "left")
    threshold = F.when(F.col("rest") == 0, "").otherwise(F.coalesce("taken", F.lower(first), F.lit("g")))
    return materialise(edge.select("mix_source", "passes", threshold.alias("threshold")), "mix-plan"), k / GRID


def mix(docs: DataFrame, target: Target, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_key`` (the place in the permutation), ``copies`` (how often the
    mixture holds the row) and ``exponent``."""
    rows = keyed(docs, seed, id_col, text_col, source_col)
    narrow = materialise(rows.select("mix_source", "mix_key", "mix_tokens"), "mix-rows")
    per_source, exponent = plan(narrow, target)
    per_source = per_source.withColumnsRenamed({"passes": "mix_passes", "threshold": "mix_threshold"})
    copies = F.col("mix_passes") + F.when(F.col("mix_key") <= F.col("mix_threshold"), 1).otherwise(0)
    mixed = rows.join(per_source, "mix_source").withColumn("copies", copies.cast("bigint")).withColumn("exponent", F.lit(exponent))
    return mixed.drop("mix_source", "mix_passes", "mix_threshold")


def realise(docs: DataFrame, target: Target, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mixture, each as often as it has copies, with the columns of ``docs`` and their
    values, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {name.lower(): f"c{k}" for k, name in enumerate(names)}
    mixed = mix(plain, target, seed, at[id_col.lower()], at[text_col.lower()], at[source_col.lower()])
    passes = mixed.where("copies > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return passes.select(*plain.columns).toDF(*names)


ORACLE = """
WITH k AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS t,
  left(md5('7:' || coalesce(doc_id::VARCHAR, '')), 15) AS key FROM documents),
src AS (SELECT s, sum(t)::DOUBLE AS t FROM k GROUP BY s), tot AS (SELECT sum(t) AS total, count(*) FILTER (t > 0) AS n FROM src),
g AS (SELECT a, sum(exp(a / 1024.0 * ls)) AS z, ln(sum(exp(a / 1024.0 * ls))) - a / 1024.0 * sum(ls * exp(a / 1024.0 * ls)) / sum(exp(a / 1024.0 * ls)) AS h,
  max(exp((a / 1024.0 - 1) * ls)) / sum(exp(a / 1024.0 * ls)) AS ratio
  FROM (SELECT a, ln(t / total) AS ls FROM src, tot, range(0, 1025) r(a) WHERE t > 0) GROUP BY a),
e AS (SELECT greatest((SELECT max(a) FROM g, tot WHERE h >= 0.98 * ln(n) - 1e-12), (SELECT min(a) FROM g WHERE ratio <= 4 + 1e-12)) AS a),
q AS (SELECT s, src.t AS t, floor(exp(e.a / 1024.0 * ln(src.t / total)) / z * total + 1e-6)::BIGINT AS quota, e.a / 1024.0 AS exponent FROM src, tot, e, g WHERE g.a = e.a AND src.t > 0),
c AS (SELECT k.*, quota // q.t::BIGINT AS passes, quota % q.t::BIGINT AS rest, exponent, sum(k.t) OVER (PARTITION BY k.s ORDER BY key) AS upto FROM k JOIN q USING (s))
SELECT doc_id, source, t AS n_tokens, key AS mix_key, passes + (upto <= rest)::INT AS copies, exponent::DOUBLE AS exponent FROM c
"""
