"""Preference formatting: the common beginning of two conversations becomes the prompt, what follows
becomes a pair of completions with loss masks.  DataFrame functions only.

Input rows are turns.  Conversations ``2 p`` and ``2 p + 1`` make pair ``p``: the even one is chosen, the
odd one rejected (``pairs_by_id``), or the caller names pair and side himself.  All turns of a pair meet
in one row by a single shuffle on the pair, as they must to become one training example; a pair's size
is that of its two conversations, however many rows the table has.

Cases: a pair with one side only gives no row; null role is ``unknown`` and null text empty; turns
with the same number go by role, then text; the same turn twice is two turns; identical conversations
have empty completions; turns of any length are taken whole; negative ids pair up like the others (-2 with
-1); an empty table gives no rows; extra columns are ignored; null ids give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def pairs_by_id(turns: DataFrame) -> DataFrame:
    """Turns with ``pair_id`` and ``side`` (0 chosen, 1 rejected) from ``conv_id``."""
    side = F.pmod(F.col("conv_id"), F.lit(2))  # the pair rounds down, so negative ids pair up like the others
    return turns.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), side.cast("int").alias("side"), "turn", "role", "text")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Runs ``characters:flag`` of the rendered completion, one per turn; flag 1 trains.  A turn's header
    is never trained, its text and end mark are if the role is the trained one."""
    head = lambda t: F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
    body = lambda t: F.length(F.concat(t["text"], F.lit(CLOSE)))
    run = lambda t: F.concat(head(t).cast("string"), F.lit(":0,"), body(t).cast("string"), F.when(t["role"] == TRAINED_ROLE, ":1").otherwise(":0"))
    return F.array_join(F.transform(turns, run), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair from turns (pair_id, side, turn, role, text): ``n_prompt_turns``, ``prompt``,
    ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``."""
    one = F.struct("side", "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = turns.where("pair_id is not null and side in (0, 1)").groupBy("pair_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    rows = rows.select("pair_id", F.filter("all", lambda t: t["side"] == 0).alias("c"), F.filter("all", lambda t: t["side"] == 1).alias("r")).where("size(c) > 0 and size(r) > 0")
    differ = F.array_position(F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False))), False)
    rows = rows.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    return rows.select("pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"), _render(F.slice(F.col("c"), F.lit(1), F.col("n"))).alias("prompt"),
                       _render(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"), _render(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"))


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM t),
c AS (SELECT * FROM n WHERE side = 0), r AS (SELECT * FROM n WHERE side = 1),
p AS (SELECT pair_id FROM c INTERSECT SELECT pair_id FROM r),
j AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.i = r.i),
k AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM j WHERE pair_id IN (SELECT pair_id FROM p) GROUP BY pair_id),
s AS (SELECT n.pair_id, n.side, n.i, k.n AS cut, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s,
  length('<|im_start|>' || role || chr(10)) || ':0,' || length(text || '<|im_end|>' || chr(10)) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS m
  FROM n JOIN k ON n.pair_id = k.pair_id)
SELECT pair_id, max(cut)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= cut), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > cut), '') AS chosen,
  coalesce(string_agg(m, ',' ORDER BY i) FILTER (side = 0 AND i > cut), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > cut), '') AS rejected,
  coalesce(string_agg(m, ',' ORDER BY i) FILTER (side = 1 AND i > cut), '') AS rejected_mask
FROM s GROUP BY pair_id
"""
