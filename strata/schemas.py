"""Fixed schemas of the programme tables and ``conform`` (aliases, drift guards)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

L, S, D, I, TS = T.LongType(), T.StringType(), T.DateType(), T.IntegerType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# One StructType per programme table.  Flag columns are strings: the source may
# hold booleans, numbers or words, and ``truthy`` reads their text form.
SCHEMAS: dict[str, T.StructType] = {
    "region": _struct(("region_id", L), ("region_name", S)),
    "city": _struct(("city_id", L), ("city_name", S), ("region_id", L)),
    "community": _struct(("community_id", L), ("community_name", S), ("city_id", L)),
    "product_type": _struct(("product_type_id", L), ("product_type_name", S)),
    "sport_type": _struct(("sport_type_id", L), ("sport_type_name", S)),
    "academy": _struct(("academy_id", L), ("academy_code", S), ("community_id", L), ("product_type_id", L)),
    "cohort": _struct(("cohort_id", L), ("academy_id", L)),
    "participant": _struct(("participant_id", L), ("cohort_id", L), ("enrollment_date", D), ("is_active", S)),
    "session": _struct(("session_id", L), ("cohort_id", L), ("session_date", D), ("duration_minutes", I)),
    "attendance": _struct(("attendance_id", L), ("session_id", L), ("participant_id", L),
                          ("attendance_status", S)),
    "skill_achievement": _struct(("skill_achievement_id", L), ("participant_id", L), ("skill_id", L),
                                 ("achieved_at", TS)),
}

DIMENSIONS = ("region", "city", "community", "academy", "cohort", "product_type", "sport_type")
FACTS = ("participant", "session", "attendance", "skill_achievement")

# Documented column names that differ from the names the code works with.
ALIASES: dict[str, dict[str, str]] = {
    "region": {"region": "region_name"},
    "attendance": {"attended": "attendance_status"},
}

# Dimension keys must be non-null: a NULL key would never match in SQL equality.
KEYS: dict[str, str] = {
    "region": "region_id", "city": "city_id", "community": "community_id",
    "product_type": "product_type_id", "sport_type": "sport_type_id",
    "academy": "academy_id", "cohort": "cohort_id",
}


# Layout columns kept when a table carries them (see sources/layout.py).
LAYOUT_COLUMNS: dict[str, tuple[str, ...]] = {"session": ("session_month",), "attendance": ("session_month",)}


def conform(df: DataFrame, table: str, keep_layout: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto the fixed schema of ``table``.

    Renames documented aliases, casts to the declared types, adds missing
    optional columns as typed NULL (a missing metric column then yields 0 or
    NULL instead of an error) and drops rows with a NULL dimension key; the columns
    ``extra`` stay as they are.  Pure projection + filter, so Catalyst prunes and
    pushes through it.
    """
    schema = SCHEMAS[table]
    present = set(df.columns)
    for src, dst in ALIASES.get(table, {}).items():
        if src in present and dst not in present:
            df = df.withColumnRenamed(src, dst)
            present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            c = F.col(field.name)
            if isinstance(field.dataType, T.DateType):
                c = F.to_date(c)
            else:
                c = c.cast(field.dataType)
        else:
            c = F.lit(None).cast(field.dataType)
        cols.append(c.alias(field.name))
    if keep_layout:
        cols += [F.col(c) for c in LAYOUT_COLUMNS.get(table, ()) if c in present]
    cols += [F.col(c) for c in extra]
    out = df.select(*cols)
    key = KEYS.get(table)
    if key is not None:
        out = out.filter(F.col(key).isNotNull())
    return out


def empty(spark, table: str) -> DataFrame:
    """A typed empty table: what a failed load becomes."""
    return spark.createDataFrame([], SCHEMAS[table])
