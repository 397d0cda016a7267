"""KPIs for one scope, and for every drill-down level at once.

Each fact is aggregated on its own (never joined to another fact: that would
multiply counts).  The one-row (or one-row-per-level) results are stacked with a
union and collapsed with one small aggregation, so there is no cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.bits import bit_of, block_of
from strata.functions.dates import as_datetime
from strata.operators.scope import Scoped, attendance_normalized, participants_normalized
from strata.sources.tables import Tables

KPI_COLUMNS = ("total_participants", "active_participants", "avg_days_enrolled",
               "total_sessions", "unique_session_days", "avg_session_duration",
               "total_attendances", "attendance_rate", "participants_attended",
               "total_achievements", "unique_skills_achieved", "participants_with_achievements")
# Means and the ratio their row count guards: an empty fact gives 0, as in the
# dashboard; rows that are all NULL give NULL.
MEANS = {"avg_days_enrolled": ("days_sum", "days_n", "total_participants"),
         "avg_session_duration": ("dur_sum", "dur_n", "total_sessions"),
         "attendance_rate": ("flags_sum", "total_attendances", "total_attendances")}

LEVEL_OF_GROUPING = {0: "academy", 1: "community", 3: "city", 7: "region", 15: "all"}
ROLLUP_KEYS = ("region_id", "city_id", "community_id", "academy_id")


def _days_enrolled(as_of) -> Column:
    # Whole days from enrolment to as_of (floor), which is the date difference.
    return F.datediff(F.lit(as_datetime(as_of).date()), F.col("enrollment_date"))


def _participant_parts(as_of) -> list[Column]:
    return [F.count(F.lit(1)).alias("total_participants"),
            F.count_if(F.col("is_active_normalized")).alias("active_participants"),
            F.sum(_days_enrolled(as_of)).alias("days_sum"),
            F.count(_days_enrolled(as_of)).alias("days_n")]


def _session_parts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_sessions"),
            F.count_distinct("session_date").alias("unique_session_days"),
            F.sum("duration_minutes").alias("dur_sum"), F.count("duration_minutes").alias("dur_n")]


def _attendance_parts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_attendances"),
            F.count_if(F.col("attended_normalized")).alias("flags_sum"),
            F.count_distinct("participant_id").alias("participants_attended")]


def _skill_parts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_achievements"),
            F.count_distinct("skill_id").alias("unique_skills_achieved"),
            F.count_distinct("participant_id").alias("participants_with_achievements")]


def _finish(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts default to 0, means are sum/n with the empty-fact rule, doubles
    rounded to 6 places."""
    cols = [F.col(k) for k in keys]
    present = set(df.columns)
    for name in KPI_COLUMNS:
        if name in MEANS:
            s, n, rows = MEANS[name]
            if s not in present:
                continue
            scale = 100.0 if name == "attendance_rate" else 1.0
            value = F.try_divide(F.col(s).cast("double") * scale, F.col(n))
            cols.append(F.round(F.when(F.coalesce(F.col(rows), F.lit(0)) == 0, F.lit(0.0))
                                .otherwise(value), 6).alias(name))
        elif name in present:
            cols.append(F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))
    return df.select(*cols)


def stack_parts(parts: list[DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """Union the per-fact results and keep, per key, the one non-null value of
    each column.  Inputs are already aggregated, so this is a tiny aggregation."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    value_cols = [c for c in stacked.columns if c not in keys]
    grouped = stacked.groupBy(*keys) if keys else stacked.groupBy()
    return grouped.agg(*[F.max(c).alias(c) for c in value_cols])


def participant_kpis(scoped: Scoped, as_of) -> DataFrame:
    return _finish(scoped.participants.agg(*_participant_parts(as_of)))


def session_kpis(scoped: Scoped) -> DataFrame:
    return _finish(scoped.sessions.agg(*_session_parts()))


def attendance_kpis(scoped: Scoped) -> DataFrame:
    return _finish(scoped.attendance.agg(*_attendance_parts()))


def skill_kpis(scoped: Scoped) -> DataFrame:
    return _finish(scoped.skills.agg(*_skill_parts()))


def skills_per_participant(skills: DataFrame) -> DataFrame:
    """(participant_id, achievements, skills): the skills of one participant are few, and distinct."""
    return skills.filter("participant_id is not null").groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("achievements"), F.collect_set("skill_id").alias("skills"))


def _participants_with_skills(participants: DataFrame, skills: DataFrame, as_of, *keys: str) -> DataFrame:
    """One row per participant (and ``keys``): its parts, its achievements and their skills.  Participants are read
    once for their own KPIs and for those of the skills."""
    own = participants.groupBy("participant_id", *keys).agg(*_participant_parts(as_of))
    return own.join(skills_per_participant(skills), "participant_id", "left")


def _people_kpis(scoped: Scoped, all_skills: DataFrame, as_of) -> DataFrame:
    """The parts of participants and skills in one pass: each participant's row is repeated per skill, its
    additive parts count on the first."""
    people = _participants_with_skills(scoped.participants, all_skills, as_of)
    parts = ("total_participants", "active_participants", "days_sum", "days_n", "achievements")
    rows = people.select(*parts, F.posexplode_outer("skills").alias("place", "skill_id"))
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    sums = [F.sum(F.when(first, F.col(p))).alias(p if p != "achievements" else "total_achievements") for p in parts]
    return rows.agg(*sums, F.count(F.when(first, F.col("achievements"))).alias("participants_with_achievements"),
                    F.count_distinct("skill_id").alias("unique_skills_achieved"))


def kpis(scoped: Scoped, as_of) -> DataFrame:
    """All 12 KPIs of one scope as one row: three separate aggregations (participants with their skills,
    sessions, attendance), stacked and collapsed."""
    skills = scoped.skills if scoped.all_skills is None else scoped.all_skills
    return _finish(stack_parts([_people_kpis(scoped, skills, as_of), scoped.sessions.agg(*_session_parts()),
                                scoped.attendance.agg(*_attendance_parts())]))


def kpis_rollup(tables: Tables, hierarchy: DataFrame, as_of) -> DataFrame:
    """KPIs for every region, city, community and academy, and the total.

    One pass over each fact.  Each fact is reduced to a grain keyed by academy and a block of 64 neighbouring values
    of what its distinct measure counts, held as the bits of a long (``functions.bits``) -- sessions per (academy,
    dates), attendance per (academy, participants), participants with their skills per (academy, skills) and
    (academy, participants) -- with its additive parts alongside.  The grains are stacked as tagged rows and meet by
    (measure, block) in one shuffle: there the blocks of the academies are united for their communities, cities
    and regions, so each node counts a value once.
    What follows has one row per node and measure: counts are added up, and the additive parts of the
    academies go to the nodes above.  Every academy and every parent of the hierarchy gets a row (zeros when
    it has no facts); the grouping id tells a subtotal from a NULL parent stored in the data.
    """
    h = hierarchy.select(*ROLLUP_KEYS, F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in ROLLUP_KEYS]).alias("path"))
    cohort_academy = tables["cohort"].select("cohort_id", "academy_id").join(h.select("academy_id"), "academy_id")
    sessions = tables["session"].join(cohort_academy, "cohort_id")
    participants = participants_normalized(tables).join(cohort_academy, "cohort_id")
    attendance = attendance_normalized(tables).join(sessions.select("session_id", "academy_id").hint("shuffle_hash"), "session_id")
    people = _participants_with_skills(participants, tables["skill_achievement"], as_of, "academy_id")
    one = F.count(F.lit(1))
    parts = ("n", "flags", "days_sum", "days_n", "dur_sum", "dur_n")

    def entry(measure: str, block=None, bits=None, **cols) -> Column:
        longs = {"block": block, "bits": bits} | {p: cols.get(p) for p in parts}
        return F.struct(F.lit(measure).alias("measure"), *[(F.lit(None) if v is None else v).cast("long").alias(c) for c, v in longs.items()])

    def bits(value) -> Column:
        return F.bit_or(bit_of(value)).alias("bits")

    # a participant counts for itself, as an achiever, and once for each of its skills
    own = entry("participants", n=F.col("total_participants"), flags=F.col("active_participants"), days_sum=F.col("days_sum"), days_n=F.col("days_n"))
    who = F.when(F.col("achievements").isNotNull(), F.col("participant_id"))
    achiever = entry("achievers", block_of(who), bit_of(who), n=F.col("achievements"))
    learnt = F.transform(F.coalesce("skills", F.array().cast("array<bigint>")), lambda k: entry("skills", block_of(k), bit_of(k)))
    day = F.unix_date("session_date").cast("long")
    of_people = people.select("academy_id", F.explode(F.concat(F.array(own, achiever), learnt)).alias("e")).select("academy_id", "e.*")
    of_sessions = sessions.groupBy("academy_id", block_of(day).alias("block")).agg(
        bits(day), one.alias("n"), F.sum("duration_minutes").alias("dur_sum"), F.count("duration_minutes").alias("dur_n"))
    of_attendance = attendance.groupBy("academy_id", block_of("participant_id").alias("block")).agg(
        bits("participant_id"), one.alias("n"), F.count_if("attended_normalized").alias("flags"))
    sums = [F.sum(p).alias(p) for p in parts]
    grains = [of_people.groupBy("measure", "block", "academy_id").agg(F.bit_or("bits").alias("bits"), *sums).select("academy_id", F.struct("measure", "block", "bits", *parts).alias("e")),
              of_sessions.select("academy_id", entry("sessions", F.col("block"), F.col("bits"), n=F.col("n"), dur_sum=F.col("dur_sum"), dur_n=F.col("dur_n")).alias("e")),
              of_attendance.select("academy_id", entry("attendance", F.col("block"), F.col("bits"), n=F.col("n"), flags=F.col("flags")).alias("e"))]
    grain = reduce(lambda a, b: a.unionByName(b), grains).select("academy_id", "e.*").repartition("measure", "block")

    # a node is its path and its depth; an academy's block goes to each node above it, its additive parts stay
    places = h.select("academy_id", F.array(*[F.struct(F.substring_index("path", "/", depth).alias("path"), F.lit(depth).alias("depth")) for depth in range(5)]).alias("places"))
    spread = grain.join(places, "academy_id").select("measure", "block", "bits", *parts, F.explode("places").alias("p"))
    kept = [F.when(F.col("p.depth") == 4, F.col(p)).alias(p) for p in parts]
    nodes = spread.select("measure", "block", "bits", "p.*", *kept).groupBy("measure", "block", "path", "depth").agg(F.bit_or("bits").alias("bits"), *sums)
    nodes = nodes.groupBy("measure", "path", "depth").agg(F.sum(F.bit_count("bits")).alias("distinct_values"), *sums)

    # one row per node and measure from here on: an academy's parts go to the nodes above it
    here = F.struct("path", "depth", "distinct_values", *parts)
    higher = [F.struct(F.substring_index("path", "/", depth).alias("path"), F.lit(depth).alias("depth"), F.lit(0).cast("long").alias("distinct_values"), *parts) for depth in range(4)]
    per_node = nodes.select("measure", F.explode(F.when(F.col("depth") == 4, F.array(here, *higher)).otherwise(F.array(here))).alias("s")).select("measure", "s.*")

    def pick(measure: str, col: str, name: str):
        return F.sum(F.when(F.col("measure") == measure, F.col(col))).alias(name)

    wide = per_node.groupBy("path", "depth").agg(
        pick("participants", "n", "total_participants"), pick("participants", "flags", "active_participants"),
        pick("participants", "days_sum", "days_sum"), pick("participants", "days_n", "days_n"),
        pick("sessions", "n", "total_sessions"), pick("sessions", "distinct_values", "unique_session_days"),
        pick("sessions", "dur_sum", "dur_sum"), pick("sessions", "dur_n", "dur_n"),
        pick("attendance", "n", "total_attendances"), pick("attendance", "flags", "flags_sum"),
        pick("attendance", "distinct_values", "participants_attended"),
        pick("achievers", "n", "total_achievements"), pick("skills", "distinct_values", "unique_skills_achieved"),
        pick("achievers", "distinct_values", "participants_with_achievements"))
    # every node of the hierarchy, with or without facts
    gids = dict(zip(range(4, -1, -1), LEVEL_OF_GROUPING))
    prefix = [F.struct(F.substring_index("path", "/", depth).alias("path"), F.lit(depth).alias("depth"), F.lit(gids[depth]).cast("long").alias("gid"),
                       *[(F.col(k) if j < depth else F.lit(None).cast(h.schema[k].dataType)).alias(k) for j, k in enumerate(ROLLUP_KEYS)]) for depth in range(5)]
    every = h.select(F.explode(F.array(*prefix)).alias("n")).select("n.*").distinct()
    out_keys = ROLLUP_KEYS + ("gid",)
    out = _finish(every.join(wide, ["path", "depth"], "left"), out_keys)
    level = F.create_map(*[x for g, name in LEVEL_OF_GROUPING.items() for x in (F.lit(g), F.lit(name))])
    return out.select(level[F.col("gid")].alias("level"), *[c for c in out.columns])
