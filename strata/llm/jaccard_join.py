"""Exact n-gram Jaccard join of all documents, with set relations used to skip work.

A document's set is its distinct word n-grams, as 64-bit hashes.  The join links sets whose
``100 * |A & B| >= percent * |A | B|`` and labels each document with the smallest id that links
reach.  Steps, each a Spark job over hashed columns:

1. *Equal sets* become one class (map-side combined, named by a hash of the set), so copies never meet a join.
2. *Index lists*.  Two linked sets share a hash among the first ``n - ceil(t n) + 1`` ("prefix") of
   either one, under any common order of the hashes.  The order used puts a fixed part of the hash
   space (``eligible_below``) first, rarest hash first, counted over all documents; a set with too few of
   those fills its prefix from the rest by hash value.  Hashes of one set only drop out, the others
   form index lists of (hash, size band, position).
3. *Skipped blocks*.  A list is cut by size band: sets whose sizes differ by more than the threshold
   allows never meet; pairs are skipped whose positions leave too little room for the needed overlap, or
   whose parity sketches differ in more cells than linked sets may differ in hashes (a lower bound, so exact).
4. *Derived answers*.  Instead of all pairs of a list, each list links its sets to one pivot; pairs
   whose sets are already connected need no look (their answer follows from the pivots' answers).
   Some rounds with other pivots connect large groups; what is left, pairs of one list between
   different components, is then checked in full, after skipping pairs that the distances to a
   common pivot exclude (Jaccard distance is a metric: |d(p,x) - d(p,y)| <= d(x,y)).
5. Links are verified on the whole sets, rebuilt from the texts of just the sets in candidate pairs.

No link between different texts is lost: steps 2 to 4 drop only pairs that cannot link or whose
ends are connected anyway.  Cases: null text, or a text without words: empty set, linked with nothing;
fewer than n words: the whole sequence is the one n-gram; texts of any length are taken whole; repeated rows share a
class; unlike texts that share an id are documents of their own; rows without an id link nothing; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from strata.llm import pieces as P
from strata.llm.common import give_back, map_text, materialise, text_chunks, texts_of

PIVOT_ROUNDS = 2
WORDS = 8  # 64-bit words of a set's parity sketch: a bit tells if an odd number of its hashes fall into a cell
CELL_BITS = (64 * WORDS).bit_length() - 1
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (letters A-Z lowered)."""
    cp, offsets = P.codepoints(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
    starts, lengths, before = P.word_spans(cp, offsets)
    words = P.span_hashes(cp, starts, lengths)
    grams = P.ngram_hashes(words, n)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(P.mix(P.ngram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """128 bits of each set, as two signed words."""
    found = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    return [(f >> 64) - (1 << 63) for f in found], [(f & (1 << 64) - 1) - (1 << 63) for f in found]


def eligible_below(percent: int) -> np.uint64:
    """Hashes below this come first in the order of the prefix: twice the part that a prefix takes."""
    return np.uint64(min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, with_tokens: bool) -> DataFrame:
    """(doc_id, n, hi, lo): size and 128-bit fingerprint of each set; with tokens also the hashes
    that may fall into its prefix (eligible ones by value, then the fill) and how many are eligible."""
    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id bigint, n bigint, hi bigint, lo bigint" + (", n_first int, hashes array<bigint>, parity array<bigint>" if with_tokens else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, 1):
                sizes, firsts, tokens, parities = [], [], [], []
                sets = shingle_sets(texts_of(chunk, 1), n)
                his, los = fingerprints(sets)
                for s in sets:
                    sizes.append(len(s))
                    if with_tokens:
                        first = int(np.searchsorted(s, eligible_below(percent)))
                        firsts.append(first)
                        odd = np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS) & 1
                        parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                        tokens.append(s[:max(first, prefix_length(len(s), percent))].view(np.int64))
                cols = [chunk.column(0), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64())]
                names = ["doc_id", "n", "hi", "lo"]
                if with_tokens:
                    cols += [pa.array(firsts, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))]
                    names += ["n_first", "hashes", "parity"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(give_back(run), schema)


def index_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(hash, rep, n, pos): the prefix entries of each set that another set shares."""
    spread = sets.select("rep", "n", "n_first", F.posexplode("hashes").alias("at", "hash"))
    # counted with map-side combine and written, so that the join below reads two plain shuffles,
    # of which skewed partitions can be split
    counts = materialise(spread.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-counts")
    shared = spread.join(counts, "hash")
    own = Window.partitionBy("rep")
    eligible = F.col("at") < F.col("n_first")
    ranked = shared.withColumn("n_shared", F.sum(eligible.cast("int")).over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy(~eligible, F.when(eligible, F.col("df")).otherwise(0), "at")) - 1)
    pos = F.when(eligible, F.col("n_first") - F.col("n_shared") + F.col("rank")).otherwise(F.col("at"))
    length = F.expr(f"n - ceil({percent} * n / 100D) + 1")
    return ranked.withColumn("pos", pos).where(F.col("pos") < length).select("hash", "rep", "n", "pos")


def _band(n, percent: int):
    """Sizes of linked sets lie in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(-float(np.log(percent / 100))) + 1e-9).cast("int")


def _possible(percent: int, a: str = "a_", b: str = "b_"):
    """What sizes and positions leave possible, for entries a and b of one list.

    At the first hash that two sets share, all their common hashes lie at or behind it, so a linked
    pair passes in that list; the same pair may fail in the lists of its later common hashes.
    """
    sizes = (100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n"))
    need = F.expr(f"{percent} * ({a}n + {b}n) / {100 + percent}D - 1e-9")
    room = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return sizes & (room >= need)


def _sketched(rows: DataFrame, sketches: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows with the parity words of the set in ``key`` as columns."""
    words = sketches.select(F.col("rep").alias(key), *[F.col("parity")[k].alias(f"{prefix}p{k}") for k in range(WORDS)])
    return rows.join(words, key)


def _near(percent: int, a_n: str, b_n: str, a: str = "a_", b: str = "b_"):
    """Sets whose sketches differ in no more cells than the hashes in which linked sets may differ: each
    such hash flips one cell, so the cells that differ are a lower bound."""
    differ = F.expr(" + ".join(f"bit_count({a}p{k} ^ {b}p{k})" for k in range(WORDS)))
    return differ <= F.expr(f"{100 - percent} * ({a_n} + {b_n}) / {100 + percent}D + 1e-9")


def _banded(entries: DataFrame, percent: int) -> DataFrame:
    """Each entry under its own band and, as a visitor, under the next one."""
    own = entries.withColumn("band", _band("n", percent))
    return own.withColumn("visitor", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("visitor"))


def _class(rows: DataFrame):
    """The number of a set: a hash of its fingerprint."""
    return F.xxhash64(rows["hi"], rows["lo"], rows["n"])


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, n_a, n_b, inter) of candidate pairs; whole sets, rebuilt from the texts of just the sets in pairs.
    A document stands for its class; others that share its id are told apart by their sets."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    ids = classes.select("rep", "doc_id").join(needed, "rep", "left_semi").select("doc_id").distinct()
    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    src = src.join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a class once a task, however often its text stands there
        for batch in batches:
            for chunk in text_chunks(batch, 1):
                grams = shingle_sets(texts_of(chunk, 1), n)
                his, los = fingerprints(grams)
                new = []
                for k, mark in enumerate(zip(his, los)):
                    if mark not in seen:
                        seen.add(mark)
                        new.append(k)
                grams, his, los = ([x[k] for k in new] for x in (grams, his, los))
                yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(list(map(len, grams)), pa.int64()), pa.array([x.view(np.int64) for x in grams], pa.list_(pa.int64()))], names=["hi", "lo", "n", "grams"])

    sets = src.mapInArrow(give_back(run), "hi bigint, lo bigint, n bigint, grams array<bigint>")
    sets = sets.select(_class(sets).alias("rep"), "grams")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("grams_b")), "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("bigint").alias("inter")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root): the smallest id that the edges (a, b) reach, by alternating large-star and
    small-star passes; each pass is written to the shared folder.  The passes end when the edges are the
    same twice, told by their number and the sum of their hashes."""
    def sum_of(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = sum_of(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialise(small, name)
        before, seen = seen, sum_of(edges)
        if seen == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def join_links(docs: DataFrame, sets: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): verified links between classes, enough of them to connect every component."""
    lists = _banded(materialise(index_lists(sets, percent), "jaccard-lists"), percent)
    sketches = sets.select("rep", "parity")
    links = None
    tried = None
    for k in range(PIVOT_ROUNDS + 1):
        if links is None:
            marked = lists.withColumn("root", F.col("rep"))
        else:
            roots = components(links.select("a", "b"))
            marked = lists.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        if k:
            mixed = marked.groupBy("hash", "band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("visitor").alias("v0")).where("r0 <> r1 and v0 = 0")
            marked = marked.join(mixed.select("hash", "band"), ["hash", "band"])
        if k < PIVOT_ROUNDS:
            # one pivot for each list: first the smallest id (most lists of a group agree on it), then any
            key = F.col("rep") if k == 0 else F.xxhash64("rep", "hash", F.lit(k))
            pivots = marked.groupBy("hash", "band").agg(F.min(F.struct(key.alias("key"), F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), F.col("root").alias("b_root"))).alias("p")).select("hash", "band", "p.*")
            met = marked.join(pivots, ["hash", "band"])
        else:
            marked = _sketched(marked, sketches, "rep", "a_")
            other = marked.select("hash", "band", F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), F.col("root").alias("b_root"), F.col("visitor").alias("b_visitor"), *[F.col(f"a_p{j}").alias(f"b_p{j}") for j in range(WORDS)])
            met = marked.join(other, ["hash", "band"]).where("rep < b and visitor + b_visitor < 2")
        met = met.where("root <> b_root").withColumnsRenamed({"n": "a_n", "pos": "a_pos"}).where(_possible(percent))
        if k == PIVOT_ROUNDS:
            met = met.where(_near(percent, "a_n", "b_n"))
        pairs = met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"), F.when(F.col("rep") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("n_a"), F.when(F.col("rep") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("n_b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
            if k == PIVOT_ROUNDS:
                pairs = _unexcluded(pairs, tried, percent)
        if k < PIVOT_ROUNDS:
            columns = pairs.columns
            pairs = _sketched(_sketched(pairs, sketches, "a", "a_"), sketches, "b", "b_").where(_near(percent, "n_a", "n_b")).select(*columns)
        pairs = materialise(pairs, f"jaccard-pairs-{k}")
        if pairs.isEmpty():
            continue
        checked = materialise(_verify(pairs, docs, sets, n, id_col, text_col), f"jaccard-checked-{k}")
        tried = checked if tried is None else tried.unionByName(checked)
        links = tried.where(f"100 * inter >= {percent} * (n_a + n_b - inter)")
    return (pairs if links is None else links).select("a", "b")


def _unexcluded(pairs: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose distances to a common pivot differ by more than the threshold distance."""
    d = tried.withColumn("d", 1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter")))
    seen = d.select(F.col("a").alias("pivot"), F.col("b").alias("x"), "d")
    first = seen.groupBy("x").agg(F.min(F.struct("pivot", "d")).alias("p")).select("x", "p.*")
    a = first.select(F.col("x").alias("a"), F.col("pivot").alias("pa"), F.col("d").alias("da"))
    b = first.select(F.col("x").alias("b"), F.col("pivot").alias("pb"), F.col("d").alias("db"))
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    far = (F.col("pa") == F.col("pb")) & (F.abs(F.col("da") - F.col("db")) > 1 - percent / 100 + 1e-9)
    return known.where(~F.coalesce(far, F.lit(False))).select(*pairs.columns)


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (hi, lo, n, rep, doc_id: the smallest), and the component of each:
    (hi, lo, n, root, component_id)."""
    sets = _sets(docs, n, percent, id_col, text_col, True).where("n > 0 and doc_id is not null")
    classes = sets.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc_id"), F.first("n_first").alias("n_first"), F.first("hashes").alias("hashes"), F.first("parity").alias("parity"))
    classes = materialise(classes.withColumn("rep", _class(classes)), "jaccard-classes")
    roots = components(join_links(docs, classes, n, percent, id_col, text_col)).withColumnRenamed("id", "rep")
    rooted = classes.select("hi", "lo", "n", "rep", "doc_id").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialise(rooted, "jaccard-roots")
    return rooted, rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    members = _sets(docs, n, percent, id_col, text_col, False)
    classes, labels = _classes(docs, n, percent, id_col, text_col)
    named = classes.join(labels, "root").select("hi", "lo", F.col("n").alias("size"), "component_id")
    same = (members["hi"] == named["hi"]) & (members["lo"] == named["lo"]) & (members["n"] == named["size"])
    return members.join(named, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row stays, of the smallest id.  Rows
    that repeat an id with the same set of n-grams count as copies, rows that repeat an id with another set are
    documents of their own; rows without n-grams are linked with nothing, and rows without an id stay."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {name.lower(): f"c{k}" for k, name in enumerate(names)}
    id_at, text_at = at[id_col.lower()], at[text_col.lower()]
    classes, _ = _classes(plain, n, percent, id_at, text_at)
    first = classes.groupBy("root").agg(F.min(F.struct("doc_id", "hi", "lo", "n")).alias("f")).select("f.*")

    def marks(texts: list[str], _: pa.Array) -> dict[str, object]:
        sets = shingle_sets(texts, n)
        hi, lo = fingerprints(sets)
        return {"hi": hi, "lo": lo, "n": list(map(len, sets))}

    marked = map_text(plain, marks, T.StructType([T.StructField(c, T.LongType()) for c in ("hi", "lo", "n")]), text_at)
    keys = ["doc_id", "hi", "lo", "n"]
    marked = marked.withColumn("doc_id", F.col(id_at).cast("bigint"))
    # one shuffle by the keys serves the join and the choice among repeated rows
    found = marked.where("doc_id is not null").join(first.withColumn("first", F.lit(True)), keys, "left")
    kept = found.where("n = 0 or first").dropDuplicates(keys).select(*plain.columns)
    return kept.unionByName(plain.where(F.col(id_at).cast("bigint").isNull())).toDF(*names)
