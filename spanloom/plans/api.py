"""The engine's read interface: one method per endpoint, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import status
from spanloom.operators import assembly
from spanloom.operators import config as cfg
from spanloom.session import ship
from spanloom.sources import events, store
from spanloom.sources.tables import table
from spanloom.workdir import exists, new_path

FACETS = ("scope1", "scope2", "scope3", "env", "service_identity")


class Engine:
    """Reads over one data folder, and spans that come in beside it. Lists are limited in the plan, not after it; reads of one trace prune folders and row
    groups of the laid out spans, which are written at the first such read. ``settings`` is a folder where choices are kept."""

    def __init__(self, spark: SparkSession, folder: str, config: cfg.Config = cfg.Config(), settings: str | None = None):
        ship(spark)
        self.spark, self.folder, self.config, self.settings = spark, folder, config, settings
        self.active = config.active
        if settings and exists(spark, settings):
            self.active = spark.read.parquet(settings).filter("name = 'active'").collect()[0].value
        self._inbox: str | None = None
        self._store: str | None = None

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    # spans that come in

    def ingest(self, requests: list[str], arrival_us: int) -> DataFrame:
        """Takes JSON requests, one span or an array each: a row per request with its number, ``accepted, rejected, error``. Spans count from the next read on."""
        df = self.spark.createDataFrame(list(enumerate(requests)), "request int, body string")
        spans, report = events.ingest(df, "request", "body")
        low = {"TraceID": "trace_id", "SpanID": "span_id", "ParentID": "parent_id", "OperationName": "operation_name", "StartTime": "start_time", "Duration": "duration", "Tags": "tags", "ServiceName": "service_name"}
        rows = spans.select(*[F.col(a).alias(b) for a, b in low.items()], F.lit(arrival_us).cast("bigint").alias("arrival"), F.lit(None).cast("bigint").alias("batch_id"))
        self._inbox = self._inbox or new_path(self.spark, "inbox")
        rows.write.mode("append").parquet(self._inbox)
        self._store = None
        return report.orderBy("request")

    def spans(self) -> DataFrame:
        """Raw spans of the folder and those that came in; the latter win."""
        x = table(self.spark, self.folder, "spans")
        return assembly.with_memory(x, self.spark.read.parquet(self._inbox).select(*x.columns)) if self._inbox else x

    def _spans_of(self, trace_id: str) -> DataFrame:
        if self._store is None:
            path = new_path(self.spark, "span-store")
            store.build(self.spans(), path)
            self._store = path
        x = store.spans_of(self.spark, self._store, trace_id)
        return x.select(
            "trace_id", "span_id", F.col("parent_id").alias("parent_span_id"), "service_name", "operation_name", "start_time", F.col("duration").alias("duration_us"), status(F.col("tags")).alias("status")
        ).orderBy("start_time", "span_id")

    def _q(self, name: str) -> DataFrame:
        from spanloom.plans import engine_queries as e

        return e.QUERIES[name](self.spark, self.folder)

    def _traces(self) -> DataFrame:
        from spanloom.plans import engine_queries as e

        return e.traces(self.spark, self.folder)

    def _findings(self, kind: str, min_score: float | None, variant: str, service_id: str | None, limit: int) -> DataFrame:
        from spanloom.plans import engine_queries as e

        f = e.findings(self.spark, self.folder).filter(F.col("kind") == kind)
        if service_id:
            f = f.filter(F.col("service_id") == service_id)
        if min_score is not None:
            f = f.filter((F.col("score") >= min_score) & ~F.isnan("score"))
        if variant:
            f = f.filter(F.col("variant") == variant)
        return f.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def services(self, search: str = "", only_errors: bool = False, only_deviations: bool = False, only_anomalies: bool = False, **parts: str) -> DataFrame:
        """Service list with findings; ``parts`` are values of scope1-3, env or service_identity."""
        g = table(self.spark, self.folder, "service_groupings").select("service_id", *FACETS)
        out = self._q("ref_a1_services").join(g, "service_id", "left")
        for k, v in parts.items():
            if k not in FACETS:
                raise ValueError(f"no such part: {k}")
            if v:
                out = out.filter(F.col(k) == v)
        if search:
            out = out.filter(F.lower("service_id").contains(search.lower()))
        for on, c in ((only_errors, "error_rate"), (only_deviations, "deviation_count"), (only_anomalies, "anomaly_count")):
            if on:
                out = out.filter(F.col(c) > 0)
        return out.orderBy("service_id")

    def service(self, service_id: str) -> DataFrame:
        """One service; an unknown one raises LookupError."""
        out = self.services().filter(F.col("service_id") == service_id)
        if not self._traces().filter(F.col("service_id") == service_id).limit(1).count():
            raise LookupError(f"no such service: {service_id!r}")
        return out

    def topologies(self, service_id: str) -> DataFrame:
        return self._q("ref_a3_topologies").filter(F.col("service_id") == service_id).orderBy(F.desc("n"), "fingerprint")

    def topology_example(self, service_id: str, fingerprint: str) -> DataFrame:
        """Spans of the first trace of a path."""
        t = self._traces().filter((F.col("service_id") == service_id) & (F.col("fingerprint") == fingerprint)).orderBy("start_us", "trace_id").limit(1).collect()
        return self._spans_of(t[0].trace_id if t else "")

    def deviations(self, service_id: str | None = None, min_score: float = 0.0, variant: str = "", limit: int = 100) -> DataFrame:
        return self._findings("deviation", min_score, variant, service_id, limit)

    def anomalies(self, service_id: str | None = None, min_score: float = 3.5, variant: str = "", limit: int = 100) -> DataFrame:
        return self._findings("anomaly", min_score, variant, service_id, limit)

    def baselines(self, service_id: str) -> tuple[DataFrame, DataFrame]:
        """Totals of a service and its branches."""
        mine = F.col("service_id") == service_id
        return self._q("ref_a4_baseline_report").filter(mine), self._q("ref_a4_branch_report").filter(mine)

    def recent_traces(self, limit: int = 50) -> DataFrame:
        return self._traces().orderBy(F.desc("start_us"), "trace_id").limit(limit)

    def traces_by_fingerprint(self, fingerprint: str, limit: int = 50) -> DataFrame:
        return self._traces().filter(F.col("fingerprint") == fingerprint).orderBy(F.desc("start_us"), "trace_id").limit(limit)

    def trace(self, trace_id: str) -> DataFrame:
        return self._spans_of(trace_id)

    def interesting(self, variant: str = "", limit: int = 50) -> DataFrame:
        from spanloom.plans import engine_queries as e

        f = e.findings(self.spark, self.folder)
        f = f.filter(F.col("variant") == variant) if variant else f
        return f.orderBy(F.desc("created_at"), "kind", F.desc("id")).limit(limit)

    def interesting_trace(self, trace_id: str) -> DataFrame:
        return self._q("ref_s14_interesting_upsert").filter(F.col("trace_id") == trace_id)

    def stats(self) -> DataFrame:
        """One row of totals."""
        from spanloom.plans.engine_queries import side_by_side

        return side_by_side(self._q("ref_a11_stats"), self._q("ref_a13_topology_total"))

    def facets(self, facet: str, **chosen: str) -> DataFrame:
        """Sorted values of a facet, given those chosen before it."""
        if facet not in FACETS or any(k not in FACETS for k in chosen):
            raise ValueError(f"no such facet: {facet} {chosen}")
        g = table(self.spark, self.folder, "service_groupings").filter(F.coalesce(facet, F.lit("")) != "")
        for k, v in chosen.items():
            g = g.filter(F.col(k) == v)
        return g.select(F.lit(facet).alias("facet"), F.col(facet).alias("value")).distinct().orderBy("value")

    # variants

    def combinations(self) -> list[str]:
        return cfg.combinations()

    def variants(self) -> dict[str, list[int]]:
        return {v: list(cfg.THRESHOLDS) for v in cfg.VARIANTS}

    def set_active(self, combination: str) -> str:
        """Chooses the combination whose findings make traces interesting; an unknown one raises ValueError."""
        self.active = ":".join(map(str, cfg.parse_combination(combination)))
        if self.settings:
            self.spark.createDataFrame([("active", self.active)], "name string, value string").coalesce(1).write.mode("overwrite").parquet(self.settings)
        return self.active

    def variant(self, combination: str) -> DataFrame:
        """Totals of one combination: ``variant, deviations, anomalies, traces``; an unknown one raises ValueError."""
        name = ":".join(map(str, cfg.parse_combination(combination)))
        return self._q("ref_a11_by_variant").filter(F.col("variant") == name)
