"""A Merkle manifest of a dataset: one tree per group (source), one tree over the groups' roots.

The leaf of a row is the sha256 of its fields.  In each group the leaves are ordered by id and numbered;
``BLOCK`` neighbouring ones, aligned, make a block, which keeps a level of its part of the tree as **one
hex string**: the parents of a level are sha256 of its fixed-width substrings (``RUN`` digests), again as
one string, up to the block's top.  The tops are the nodes of the next round, which treats them in the
same way (roots recurse; a round takes ``LEVELS`` levels off, so there are few), and the roots of the
groups are a list of nodes of one more tree.  The siblings of a node are the two substrings that flank
it in its run: a path of a row is one (left, right) pair a level, and ``fold`` recomputes the root.

All of it is SQL expressions.  Rows are numbered through a range partitioning by (group, id): each partition
counts its rows per group, and prefix sums over these counts (one row per partition and group) give
the offsets, so a group of any size is spread over partitions, and no task sees more than a partition or a
block.  The leaves, the numbered leaves and each round's blocks are written to the shared folder: texts
are read and hashed once, and a lost executor costs one step.

Cases: null fields are written ``-`` (so null and empty differ); null ids come first, and the null group comes first;
rows that share an id are ordered by leaf; exact repeats have one leaf each, next to one another; texts of
any length are hashed whole; a group of one row has its leaf as root; an empty table has no root and
gives no rows; columns besides the five of ``FIELDS`` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64  # characters of a digest
RUN = 16  # children of a node
LEVELS = 3  # levels of a block
BLOCK = RUN ** LEVELS
PART_ROWS = 1 << 20

NO_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of each row; ``text`` stands for the text column."""
    return digest(*[field(text if text is not None and name == "text" else docs[name]) for name in fields])


def group_key(group: Column) -> Column:
    """A non-null key that sorts null first and the rest bytewise."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` in each ``key``) and ``total`` (rows of the key)."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, "key", *order).sortWithinPartitions("key", *order)
    held = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    held = held.withColumn("part", F.shiftright("at", 33))
    counts = held.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    placed = held.join(offsets, ["key", "part"])
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def parents(level: Column) -> Column:
    """The level above a level: one digest for each ``RUN`` digests of the string."""
    wide = RUN * HEX
    runs = F.sequence(F.lit(0), (F.ceil(F.length(level) / wide) - 1).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(level.substr(i * wide + 1, F.lit(wide)), 256)), "")


def block_round(nodes: DataFrame, name: str) -> DataFrame:
    """(key, block, total, held, level0 .. level2, top) of nodes (key, pos, total, node, held): ``held`` is what
    each node carries, in order.  ``total`` is the number of nodes of the key in this round."""
    row = F.struct(F.col("pos"), F.col("node"), F.col("held"))
    block = F.shiftright("pos", 4 * LEVELS)
    out = nodes.groupBy("key", block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"), F.max("total").alias("total"))
    out = out.select("key", "block", "total", F.transform("rows", lambda r: r["held"]).alias("held"), F.array_join(F.transform("rows", lambda r: r["node"]), "").alias("level0"))
    for k in range(1, LEVELS):  # a level exists while the one below has several nodes
        out = out.withColumn(f"level{k}", F.when(F.col("total") > RUN ** (k - 1), parents(F.col(f"level{k - 1}"))))
    last = F.when(F.col("total") > RUN ** (LEVELS - 1), parents(F.col(f"level{LEVELS - 1}")))
    tops = [last, *[F.col(f"level{k}") for k in reversed(range(LEVELS))]]
    return materialise(out.withColumn("top", F.coalesce(*tops)), name)


def flanks(level: Column, at: Column) -> Column:
    """The siblings of digest number ``at`` of a level: what lies left and right of it in its run."""
    inside = F.pmod(at, F.lit(RUN)).cast("int")
    begin = (at - inside).cast("int") * HEX
    left = level.substr(begin + 1, inside * HEX)
    right = level.substr(begin + (inside + 1) * HEX + 1, (RUN - 1 - inside) * HEX)
    return F.struct(left.alias("left"), right.alias("right"))


def paths(blocks: DataFrame, extra: list[str]) -> DataFrame:
    """One row per node: key, pos, node, held, its (left, right) siblings level by level within the
    block as ``path``, and the columns ``extra`` of the block.  Runs are cut out first, so a node
    looks only at the string of its run."""
    runs = F.sequence(F.lit(0), (F.ceil(F.size("held") / RUN) - 1).cast("int"))
    cut = blocks.select("key", "block", "total", *extra, "held", *[f"level{k}" for k in range(LEVELS)], F.explode(runs).alias("run"))
    upper = [flanks(F.col(f"level{k}"), F.floor(F.col("run") / RUN ** (k - 1)).cast("int")) for k in range(1, LEVELS)]
    cut = cut.select("key", "block", "total", *extra, "run", F.slice("held", F.col("run") * RUN + 1, F.lit(RUN)).alias("held"),
                     F.col("level0").substr(F.col("run") * (RUN * HEX) + 1, F.lit(RUN * HEX)).alias("digests"), F.array(*upper).alias("upper"))
    each = cut.select("key", "block", "total", *extra, "run", "digests", "upper", F.posexplode("held").alias("i", "one"))
    levels = sum(((F.col("total") > RUN ** k).cast("int") for k in range(LEVELS)), F.lit(0))
    path = F.slice(F.concat(F.array(flanks(F.col("digests"), F.col("i"))), F.col("upper")), F.lit(1), levels)
    pos = F.col("block") * BLOCK + F.col("run") * RUN + F.col("i")
    return each.select("key", pos.alias("pos"), F.col("digests").substr(F.col("i") * HEX + 1, F.lit(HEX)).alias("node"), F.col("one").alias("held"), path.alias("path"), *extra)


@dataclass
class Tree:
    """The lowest blocks of a forest, and for each of them what stands above: (key, block, above, root)."""

    blocks: DataFrame
    above: DataFrame

    def rows(self, extra: list[str] | None = None) -> DataFrame:
        """(key, pos, node, held, path, root) of every lowest node."""
        joined = self.blocks.join(self.above, ["key", "block"])
        found = paths(joined, ["above", "root", *(extra or [])])
        return found.withColumn("path", F.concat("path", "above")).drop("above")

    def roots(self) -> DataFrame:
        return self.above.where("block = 0").select("key", "root")


def grow(nodes: DataFrame, name: str) -> Tree:
    """The trees of all keys over nodes (key, pos, total, node, held)."""
    rounds = [block_round(nodes, f"{name}-blocks")]
    most = rounds[0].agg(F.max("total").alias("m")).first()["m"] or 0
    while most > BLOCK:
        below, most = rounds[-1], -(-most // BLOCK)
        tops = below.select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node"), F.lit(None).cast("int").alias("held"))
        rounds.append(block_round(tops, f"{name}-tops"))
    above = rounds[-1].select("key", "block", F.array().cast(NO_PATH).alias("above"), F.col("top").alias("root"))
    for blocks in reversed(rounds[1:]):
        above = Tree(blocks, above).rows().select("key", F.col("pos").alias("block"), F.col("path").alias("above"), "root")
    return Tree(rounds[0], above)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, held: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``leaf``, ``subroot`` (of its group), ``root``, and ``path``, the siblings
    from leaf to root as array<struct<left, right>>.  ``held`` names further values to carry along."""
    held = held or {}
    src = docs.select(group_key(docs[group_col]).alias("key"), docs[id_col].alias("id"), leaf_digest(docs, fields=fields).alias("node"),
                      F.struct(docs[id_col].alias("id"), *[c.alias(n) for n, c in held.items()]).alias("held"), F.monotonically_increasing_id().alias("row"))
    leaves = materialise(src, "merkle-leaves")
    tree = grow(numbered(leaves, ["id", "node", "row"], "merkle-order").drop("id", "row"), "merkle")
    groups = tree.roots().select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("node"))
    top = grow(numbered(materialise(groups, "merkle-groups"), ["group"], "merkle-group-order").withColumnRenamed("group", "held"), "merkle-groups")
    over = top.rows().select(F.col("held").alias("key"), F.col("path").alias("to_root"), F.col("root").alias("all"))
    # the groups meet the few rows above the blocks, not the leaves
    above = tree.above.join(over, "key").select("key", "block", F.concat("above", "to_root").alias("above"), "root", F.col("all").alias("whole"))
    rows = Tree(tree.blocks, above).rows(["whole"])
    return rows.select(F.col("held.id").alias(id_col), F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), "path", *[F.col(f"held.{n}").alias(n) for n in held])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit(docs: DataFrame) -> DataFrame:
    """Tamper with every document whose crc32 of the decimal id is divisible by 5 (A-Z of its text become
    small letters) and verify all documents against the manifest of the untampered table."""
    changed = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    other = F.when(changed, leaf_digest(docs, F.translate(docs["text"], UPPER, LOWER)))  # null: untampered
    rows = manifest(docs, held={"tampered": other})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 9) -> str:
    """The same in DuckDB, one level a step (16 ** levels rows of a source at most)."""

    def tree(name: str, key: str) -> list[str]:
        """Steps over {name}0(key, pos, node, total), and {name}_roots."""
        out = []
        for k in range(levels):
            out.append(f"{name}r{k} AS (SELECT key, pos // {RUN} AS run, list(node ORDER BY pos) AS ns, any_value(total) AS total FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT key, run AS pos, CASE WHEN total > 1 THEN sha256(array_to_string(ns, '')) ELSE ns[1] END AS node, (total + {RUN - 1}) // {RUN} AS total FROM {name}r{k})")
        return out

    def climb(start: str, name: str, out: str) -> list[str]:
        """From start(id.., key, pos, node, sibs) level by level to {out}{levels}."""
        steps = [f"{out}0 AS ({start})"]
        for k in range(levels):
            left, right = f"array_to_string(list_slice(r.ns, 1, d.pos % {RUN}), '')", f"array_to_string(list_slice(r.ns, d.pos % {RUN} + 2, {RUN}), '')"
            steps.append(f"{out}{k + 1} AS (SELECT d.* EXCLUDE (pos, sibs, folded), d.pos // {RUN} AS pos, CASE WHEN r.total > 1 THEN sibs || {left} || {right} ELSE sibs END AS sibs, "
                         f"CASE WHEN r.total > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded FROM {out}{k} d JOIN {name}r{k} r ON r.key = d.key AND r.run = d.pos // {RUN})")
        return steps

    def leaf(text: str) -> str:
        parts = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"

    name = "CAST(doc_id AS VARCHAR)"
    bits = f"list_transform(range(0, 8 * strlen({name})), lambda j: CASE WHEN j % 8 = 0 THEN ascii(substr({name}, CAST(j // 8 + 1 AS INTEGER), 1)) ELSE 0 END::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT) ELSE xor(c, b) >> 1 END), 4294967295::BIGINT)"
    steps = [
        f"docs AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf, "
        f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} END AS other FROM documents)",
        "n0 AS (SELECT key, doc_id, leaf, other, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, count(*) OVER (PARTITION BY key) AS total FROM docs)",
        *tree("n", "key"),
        f"g0 AS (SELECT 0 AS key, key AS source_key, node, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM n{levels})",
        *tree("g", "key"),
        *climb("SELECT doc_id, leaf, key, pos, '' AS sibs, coalesce(other, leaf) AS folded FROM n0", "n", "d"),
        *climb(f"SELECT d.doc_id, d.leaf, g.node AS subroot, g.key, g.pos, d.sibs, d.folded FROM d{levels} d JOIN g0 g ON g.source_key = d.key", "g", "e"),
    ]
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT e.doc_id, e.leaf, e.subroot, g.node AS root, sha256(e.sibs) AS proof_sha256, e.folded AS folded_root, e.folded = g.node AS verified FROM e{levels} e JOIN g{levels} g ON g.key = e.key")


ORACLE = _oracle()
