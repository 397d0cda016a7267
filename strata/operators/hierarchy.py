"""Denormalised academy hierarchy and the drill-down option lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.sources.tables import Tables

LEVELS = ("region", "city", "community", "academy")
LEVEL_COLUMNS = {
    "region": ("region_id", "region_name"),
    "city": ("city_id", "city_name"),
    "community": ("community_id", "community_name"),
    "academy": ("academy_id", "academy_code"),
}

HIERARCHY_COLUMNS = ("academy_id", "academy_code", "community_id", "product_type_id", "community_name",
                     "city_id", "city_name", "region_id", "region_name", "product_type_name")


def build_hierarchy(tables: Tables) -> DataFrame:
    """One row per academy with its community, city, region and product type.

    Left joins, so academies with unknown parents stay (with NULL parents).
    Dimensions are pruned to key + label before each join.  Join strategy is
    Spark's: these sides are small, so the size check (static estimate, then
    AQE's runtime size) broadcasts them; if one grows, it becomes a shuffle join.
    A missing product-type table gives the label 'Unknown'.
    """
    h = tables["academy"]
    h = h.join(tables["community"].select("community_id", "community_name", "city_id"), "community_id", "left")
    h = h.join(tables["city"].select("city_id", "city_name", "region_id"), "city_id", "left")
    h = h.join(tables["region"].select("region_id", "region_name"), "region_id", "left")
    if "product_type" in tables.missing:
        h = h.withColumn("product_type_name", F.lit("Unknown"))
    else:
        h = h.join(tables["product_type"].select("product_type_id", "product_type_name"), "product_type_id", "left")
    return h.select(*HIERARCHY_COLUMNS)


def drilldown_options(hierarchy: DataFrame, scope=None, with_all: bool = False) -> DataFrame:
    """The cascading option lists: for each level, the distinct non-null labels
    under the parents chosen in ``scope`` (each with the smallest id bearing it),
    columns ``level, level_order, option_name, option_id``, sorted as shown:
    by level, then label.  ``with_all`` puts "All" (no id) first in every list.

    As in the dashboard, a level is narrowed only by the choices above it.
    """
    from strata.operators.scope import Scope

    scope = scope or Scope()
    parts = []
    narrowed = hierarchy
    for order, level in enumerate(LEVELS):
        id_col, name_col = LEVEL_COLUMNS[level]
        parts.append(
            narrowed.select(id_col, name_col).na.drop()
            .groupBy(name_col).agg(F.min(id_col).alias("option_id"))
            .select(F.lit(level).alias("level"), F.lit(order).alias("level_order"),
                    F.col(name_col).alias("option_name"), "option_id"))
        chosen = getattr(scope, f"{level}_id")
        if chosen is not None:
            narrowed = narrowed.filter(F.col(id_col) == F.lit(chosen))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if with_all:
        spark = hierarchy.sparkSession
        every = spark.createDataFrame([(lv, k, "All", None) for k, lv in enumerate(LEVELS)],
                                      "level string, level_order int, option_name string, option_id long")
        out = every.unionByName(out)
    return out.orderBy("level_order", F.coalesce((F.col("option_name") != "All") | F.col("option_id").isNotNull(), F.lit(True)),
                       "option_name")


def resolve_names(hierarchy: DataFrame, level: str) -> DataFrame:
    """Label -> id for one level: the smallest id bearing each label
    (the reference takes the first one it meets)."""
    id_col, name_col = LEVEL_COLUMNS[level]
    return (hierarchy.select(id_col, name_col).na.drop()
            .groupBy(F.col(name_col).alias("option_name"))
            .agg(F.min(id_col).alias("option_id")))


def resolve_name(hierarchy: DataFrame, level: str, name: str) -> int | None:
    """Driver-side convenience for one label: a one-row action."""
    row = resolve_names(hierarchy, level).filter(F.col("option_name") == name).first()
    return None if row is None else row["option_id"]
