"""Loading the programme tables as lazy, conformed DataFrames.

``load_tables`` reads tables that already exist (a catalog namespace or a folder
of files); ``program_tables`` derives them from the driver's TPC-H-like tables.
Nothing here runs a Spark action: every table is a plan, so filters and column
choices of the final query reach the scans.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from strata.schemas import DIMENSIONS, FACTS, conform, empty

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Tables:
    """Name -> conformed DataFrame, plus the names that could not be loaded."""

    frames: dict[str, DataFrame]
    missing: set[str] = field(default_factory=set)
    errors: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def persist(self) -> "Tables":
        """Snapshot cache: keep the small dimensions until ``unpersist``.  Facts
        stay on disk; write them with ``sources.layout`` to serve them fast."""
        for name, df in self.frames.items():
            if name in DIMENSIONS:
                df.persist()
        return self

    def unpersist(self) -> None:
        for name, df in self.frames.items():
            if name in DIMENSIONS:
                df.unpersist()


def load_tables(spark: SparkSession, location: str, fmt: str = "parquet",
                names: tuple[str, ...] = DIMENSIONS + FACTS, options: dict | None = None,
                cache: bool = False) -> Tables:
    """Bulk load: every programme table from ``location``.

    ``location`` is either a catalog namespace (``catalog.schema`` or ``schema``;
    read with ``spark.table``) or a folder holding ``<name>.<fmt>`` (or a folder
    ``<name>/``).  A table that fails to load (missing, corrupt, unreadable)
    becomes a typed empty table and the rest continue; ``errors`` holds each
    failure in full.
    """
    frames, missing, errors = {}, set(), {}
    is_path = "/" in location or location.startswith(".")
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt == "csv":
        reader = reader.option("header", True)
    for name in names:
        try:
            if is_path:
                # ``<name>.<fmt>`` first, then a folder ``<name>``; Spark resolves
                # both, so this works the same on local disks and object stores.
                try:
                    raw = reader.load(os.path.join(location, f"{name}.{fmt}"))
                except AnalysisException:
                    raw = reader.load(os.path.join(location, name))
            else:
                raw = spark.table(f"{location}.{name}")
            frames[name] = conform(raw, name, keep_layout=True)
        except Exception as exc:  # missing, corrupt or refused: typed empty table, reported
            frames[name] = empty(spark, name)
            missing.add(name)
            errors[name] = str(exc)
    tables = Tables(frames, missing, errors)
    return tables.persist() if cache else tables


class _LazyTables(dict):
    """Driver tables read on first use (a read resolves the file's schema)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise KeyError(name)
        df = self._spark.read.parquet(os.path.join(self._dir, f"{name}.parquet"))
        self[name] = df
        return df

    def items(self):
        return [(n, self[n]) for n in DRIVER_TABLES]

    def values(self):
        return [self[n] for n in DRIVER_TABLES]

    def keys(self):
        return list(DRIVER_TABLES)

    def __iter__(self):
        return iter(DRIVER_TABLES)

    def __len__(self):
        return len(DRIVER_TABLES)


# Plans are immutable, so the read and derived tables of one (session, folder)
# are built once and shared by every query.  ``reload`` forgets them.
_MEMO: dict[tuple[int, str], tuple[SparkSession, _LazyTables, dict]] = {}


def _memo(spark: SparkSession, sf_dir: str):
    key = (id(spark), os.path.abspath(sf_dir))
    hit = _MEMO.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, _LazyTables(spark, sf_dir), {})
        _MEMO[key] = hit
    return hit


def reload(spark: SparkSession | None = None) -> None:
    """Forget memoised plans and cached data so the next query re-reads
    (the dashboard's "reload" button)."""
    for key in list(_MEMO):
        if spark is None or _MEMO[key][0] is spark:
            session, _, derived = _MEMO.pop(key)
            for item in derived.values():
                item.unpersist()
            session.catalog.refreshByPath(key[1])  # drop cached file listings


def memo_slot(spark: SparkSession, sf_dir: str) -> dict:
    """Per (session, folder) store for derived plans; ``reload`` unpersists
    everything in it."""
    return _memo(spark, sf_dir)[2]


def driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's parquet tables, lazily (read on first access)."""
    return _memo(spark, sf_dir)[1]


def register_views(spark: SparkSession, sf_dir: str, tables: Tables | None = None) -> None:
    """Temp views for SQL text: the driver tables, and (prefixed ``p_``) the
    programme tables derived from them."""
    for name, df in driver_tables(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
    tables = tables or program_tables(spark, sf_dir)
    for name, df in tables.frames.items():
        df.createOrReplaceTempView(f"p_{name}")


# Fixed values of the mapping from the driver tables (see FIXTURES.md section 2):
# market segment -> product type id, and the account-balance bands that split a
# nation's customers into three communities.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BAND_EDGES = (2500, 6500)
# Order status of a part's latest order -> participant activity (1 active,
# 2 inactive, anything else unknown).
STATUS_CODES = {"O": 1, "F": 2, "P": 3}
# A segment outside the list is a product type of its own, "unknown".
UNKNOWN_SEGMENT_ID = 0


def _status_code(col):
    return F.create_map(*[x for k, v in STATUS_CODES.items() for x in (F.lit(k), F.lit(v))])[col]


def _segment_id(col):
    pairs = []
    for i, name in enumerate(SEGMENTS, start=1):
        pairs += [F.lit(name), F.lit(i).cast("long")]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(UNKNOWN_SEGMENT_ID).cast("long"))


def attendance_from_lines(lines: DataFrame) -> DataFrame:
    """Attendance rows of the driver's line items (batch or stream)."""
    status = (F.when(F.col("l_returnflag") == "N", "Present")
              .when(F.col("l_returnflag") == "R", "absent")
              .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "yes"))
    return lines.select(F.lit(None).cast("long").alias("attendance_id"), F.col("l_orderkey").alias("session_id"),
                        F.col("l_partkey").alias("participant_id"), status.alias("attendance_status"))


def first_and_last_orders(line_orders: DataFrame) -> DataFrame:
    """(l_partkey, cohort_id, first_date, last_status): the first and last order of each part, by (order
    date, order key); undated orders do not count.

    The least and greatest struct of each part, found before the only shuffle, so a part on a third of
    all lines ships one row per task.  (Grouping by part and date first would ship nearly every line.)
    """
    rows = line_orders.select("l_partkey", "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"),
                              F.coalesce(_status_code(F.col("o_orderstatus")), F.lit(0)).alias("status_code"))
    dated = F.col("day").isNotNull()
    ends = rows.groupBy("l_partkey").agg(F.min(F.when(dated, F.struct("day", "o_orderkey", "o_custkey"))).alias("first"),
                                         F.max(F.when(dated, F.struct("day", "o_orderkey", "status_code"))).alias("last"))
    return ends.select("l_partkey", F.col("first.o_custkey").alias("cohort_id"), F.col("first.day").alias("first_date"),
                       F.col("last.status_code").alias("last_status"))


def program_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Programme tables derived from the driver tables, memoised per folder."""
    derived = _memo(spark, sf_dir)[2]
    if "program" not in derived:
        derived["program"] = derive_program_tables(spark, sf_dir)
    return derived["program"]


def derive_program_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Programme tables derived from the driver tables (a pure Spark plan).

    region <- region; city <- nation; community / product_type / academy /
    cohort <- customer; session <- orders; attendance <- lineitem; participant
    <- lineitem joined with orders, first and last order per part; skill
    achievement <- purchase events.
    """
    d = driver_tables(spark, sf_dir)
    region = d["region"].select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    city = d["nation"].select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"),
                              F.col("n_regionkey").alias("region_id"))

    band = (F.when(F.col("c_acctbal") < BAND_EDGES[0], 0)
            .when(F.col("c_acctbal") < BAND_EDGES[1], 1).otherwise(2))
    cust = d["customer"].select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_mktsegment").isin(SEGMENTS), F.col("c_mktsegment")).otherwise("unknown").alias("c_mktsegment"),
        (F.col("c_nationkey").cast("long") * 3 + band).alias("community_id"),
        _segment_id(F.col("c_mktsegment")).alias("seg"))
    cust = cust.withColumn("academy_id", F.col("community_id") * 10 + F.col("seg"))
    community = cust.select(
        "community_id", F.concat(F.lit("C"), F.col("community_id").cast("string")).alias("community_name"),
        F.col("c_nationkey").alias("city_id")).distinct()
    product_type = cust.select(F.col("seg").alias("product_type_id"),
                               F.col("c_mktsegment").alias("product_type_name")).distinct()
    academy = cust.select(
        "academy_id", F.concat(F.lit("A"), F.lpad(F.col("academy_id").cast("string"), 4, "0")).alias("academy_code"),
        "community_id", F.col("seg").alias("product_type_id")).distinct()
    cohort = cust.select(F.col("c_custkey").alias("cohort_id"), "academy_id")

    orders = d["orders"]
    session = orders.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("cohort_id"),
        F.to_date("o_orderdate").alias("session_date"),
        (F.lit(20) + F.pmod(F.col("o_orderkey"), F.lit(9)) * 10).cast("int").alias("duration_minutes"))

    li = d["lineitem"]
    attendance = attendance_from_lines(li)

    line_orders = li.select("l_orderkey", "l_partkey").join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").hint("shuffle_hash"),
        F.col("l_orderkey") == F.col("o_orderkey"))
    firsts = first_and_last_orders(line_orders)
    participant = firsts.select(
        F.col("l_partkey").alias("participant_id"), "cohort_id",
        F.to_date("first_date").alias("enrollment_date"),
        F.when(F.col("last_status") == 1, "Active").when(F.col("last_status") == 2, "inactive").alias("is_active"))

    skill = d["events"].filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("skill_achievement_id"), F.col("user_id").alias("participant_id"),
        F.get_json_object("props", "$.k").cast("long").alias("skill_id"),
        F.col("ts").cast("timestamp_ntz").alias("achieved_at"))

    raw = {"region": region, "city": city, "community": community, "product_type": product_type,
           "academy": academy, "cohort": cohort, "participant": participant, "session": session,
           "attendance": attendance, "skill_achievement": skill}
    frames = {name: conform(df, name) for name, df in raw.items()}
    frames["sport_type"] = empty(spark, "sport_type")
    return Tables(frames)
