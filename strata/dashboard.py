"""The dashboard's workflow as one object: load once, pick a scope by name,
then metrics, weekly trend and the two distribution views for that scope.

Every method returns a lazy DataFrame (or, for ``select``, a Scope); nothing
is collected except the one-row id lookups of ``select``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from strata.functions.dates import as_datetime
from strata.operators import hierarchy as H
from strata.operators import metrics as M
from strata.operators import scope as SC
from strata.operators import trends as T
from strata.sources.snapshot import HOUR, Snapshot
from strata.sources.tables import Tables

# The trend periods the dashboard offers (days), default 90; any
# other number of days works, too.
TREND_PERIODS = (30, 60, 90, 180, 365)


class Dashboard:
    """Over tables that the caller holds, or (``load``) over a snapshot that is renewed when it is older than
    its time to live."""

    def __init__(self, spark: SparkSession, tables: Tables | Snapshot, as_of: dt.datetime | dt.date | str | None = None):
        self.spark = spark
        self._source = tables
        self.as_of = as_datetime(as_of) if as_of is not None else dt.datetime.now()
        self._hierarchy, self._of = None, None

    @classmethod
    def load(cls, spark: SparkSession, location: str, fmt: str = "parquet", as_of=None,
             cache: bool = False, ttl: float | None = HOUR, **options) -> "Dashboard":
        """Load every table from a catalog namespace or folder (see ``load_tables``); ``ttl`` in seconds
        (None: until ``reload``)."""
        return cls(spark, Snapshot(spark, location, fmt=fmt, ttl=ttl, cache=cache, **options), as_of)

    @property
    def tables(self) -> Tables:
        return self._source.tables if isinstance(self._source, Snapshot) else self._source

    @property
    def hierarchy(self) -> DataFrame:
        """The cached hierarchy of the current tables."""
        tables = self.tables
        if self._of is not tables:
            if self._hierarchy is not None:
                self._hierarchy.unpersist()
            self._hierarchy, self._of = H.build_hierarchy(tables).persist(), tables
        return self._hierarchy

    def options(self, scope: SC.Scope | None = None) -> DataFrame:
        """The four cascading option lists under ``scope``, sorted, "All" first."""
        return H.drilldown_options(self.hierarchy, scope, with_all=True)

    def notices(self) -> dict[str, str]:
        """Tables that could not be loaded (their numbers are 0), with the error."""
        return dict(self.tables.errors)

    def select(self, region: str | None = None, city: str | None = None, community: str | None = None,
               academy: str | None = None) -> SC.Scope:
        """Labels -> Scope ("All" or None leaves a level open).  Each level is
        looked up under the levels chosen above it, as the cascade does."""
        chosen: dict[str, int | None] = {}
        narrowed = self.hierarchy
        for level, label in (("region", region), ("city", city), ("community", community), ("academy", academy)):
            if label is None or label == "All":
                chosen[f"{level}_id"] = None
                continue
            value = H.resolve_name(narrowed, level, label)
            if value is None:
                raise ValueError(f"unknown {level}: {label!r}")
            chosen[f"{level}_id"] = value
            narrowed = SC.Scope(**{f"{level}_id": value}).filter(narrowed)
        return SC.Scope(**chosen)

    def scoped(self, scope: SC.Scope | None = None, narrow: bool = False) -> SC.Scoped:
        """The facts of a scope.  With ``narrow`` its session ids are found now and, if few, filter attendance at
        the scan (see ``scope.narrow``): for repeated looks at a small scope of a large table."""
        found = SC.apply_scope(self.tables, self.hierarchy, scope)
        return SC.narrow(self.tables, found) if narrow else found

    def metrics(self, scope: SC.Scope | None = None) -> DataFrame:
        return M.kpis(self.scoped(scope), self.as_of)

    def trends(self, scope: SC.Scope | None = None, days_back: int = 90) -> DataFrame:
        if days_back <= 0:
            raise ValueError("days_back must be a positive number of days")
        return T.attendance_trends(self.tables, self.scoped(scope), self.as_of, days_back)

    def product_mix(self, scope: SC.Scope | None = None) -> DataFrame:
        return T.product_mix_share(self.scoped(scope))

    def cohort_overview(self, scope: SC.Scope | None = None, n: int = 10) -> DataFrame:
        return T.top_academies_by_cohorts(self.scoped(scope), n)

    def all_levels(self) -> DataFrame:
        """KPIs for every region, city, community and academy at once."""
        return M.kpis_rollup(self.tables, self.hierarchy, self.as_of)

    def ask(self, question: str, scope: SC.Scope | None = None) -> dict:
        """Answer one plain-language question within ``scope`` (the chat box):
        route it, run the intent's query over the scoped tables, and phrase the
        answer; ``rows`` is a bounded preview, ``data`` all rows (lazy)."""
        from pyspark.sql import functions as F

        from strata.functions.routing import route_corrected
        from strata.plans.questions import answer_intent, answer_results
        from strata.plans.registry import Ctx

        intent = (self.spark.createDataFrame([(question,)], "question string")
                  .select(route_corrected(F.col("question")).alias("intent")).first().intent)
        ctx = Ctx.of(self.spark, self.tables, self.hierarchy, scope)
        got = answer_intent(ctx, intent, self.as_of)
        data = answer_results(ctx, [intent], self.as_of)[intent] if got["status"] == "success" else None
        return {"question": question, "data": data, **{k: got[k] for k in ("intent", "status", "row_count", "rows", "answer", "error", "seconds")}}

    def answer_batch(self, questions, scope: SC.Scope | None = None, envelope: str = "standard", results_dir: str | None = None) -> DataFrame:
        """Envelopes for a table, list or dict of questions (see ``answer_questions``)."""
        from strata.plans.questions import answer_questions, questions_frame
        from strata.plans.registry import Ctx

        ctx = Ctx.of(self.spark, self.tables, self.hierarchy, scope)
        return answer_questions(questions_frame(self.spark, questions), ctx, self.as_of, envelope, results_dir=results_dir)

    def reload(self) -> None:
        """Drop cached data and Spark's cached table metadata, then load again
        (the dashboard's "reload" button)."""
        if isinstance(self._source, Snapshot):
            self._source.reload()
        else:
            self._source.unpersist()
        if self._hierarchy is not None:
            self._hierarchy.unpersist()
        self._of = None
