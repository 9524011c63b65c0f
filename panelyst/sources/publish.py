"""Diff, replace and publish. A table version is a manifest of metric folders; unchanged metrics keep
the folder they have, and readers move to the new version when its manifest is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelyst.session import cut_lineage

KEY = ["metric", "entity", "year"]
OBS_SCHEMA = "entity string, metric string, year int, value double, value_raw string, vintage string"
STORE_SCHEMA = f"{OBS_SCHEMA}, fetched_at timestamp"


# --- proofs of change ------------------------------------------------------------------------------
def _paired(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Both sides grouped by key: one shuffle, and a duplicated key shows as a count."""
    def tagged(df, side):
        return df.select(*keys, F.lit(side).alias("_side"), F.struct(*columns).alias("_row"))

    both = tagged(left, 0).unionByName(tagged(right, 1))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_side") == 0).alias("left_rows"),
        F.count_if(F.col("_side") == 1).alias("right_rows"),
        F.max(F.when(F.col("_side") == 0, F.col("_row"))).alias("left_row"),
        F.max(F.when(F.col("_side") == 1, F.col("_row"))).alias("right_row"),
    )


def metric_verdicts(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Per metric: proven unchanged only if both hold the same keys once, with equal value and text.

    Any doubt - a duplicate, a missing row, a metric on one side only - is a change.
    """
    rows = _paired(stored, staged, KEY, ["value", "value_raw"])
    same = (F.col("left_rows") == 1) & (F.col("right_rows") == 1) & F.col("left_row").eqNullSafe(F.col("right_row"))
    return rows.groupBy("metric").agg(
        F.bool_and(same).alias("unchanged"),
        F.count_if(F.col("left_rows") == 0).alias("added"),
        F.count_if(F.col("right_rows") == 0).alias("removed"),
        F.count_if((F.col("left_rows") > 0) & (F.col("right_rows") > 0) & ~same).alias("altered"),
    )


def dimension_unchanged(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """One row. Extra stored entities do not matter: the upsert never deletes."""
    columns = [c for c in staged.columns if c != "entity"]
    rows = _paired(stored.select("entity", *columns), staged, ["entity"], columns).where(F.col("right_rows") > 0)
    same = (F.col("left_rows") == 1) & (F.col("right_rows") == 1) & F.col("left_row").eqNullSafe(F.col("right_row"))
    return rows.agg(
        F.coalesce(F.bool_and(same), F.lit(True)).alias("unchanged"), F.count_if(~same).alias("differing")
    )


def content_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-metric verdict between two stores."""
    return metric_verdicts(a, b).select("metric", F.col("unchanged").alias("identical"))


def dimensions_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric comparison of two dimensions: one row."""
    columns = [c for c in a.columns if c != "entity"]
    rows = _paired(a, b, ["entity"], columns)
    same = (F.col("left_rows") == F.col("right_rows")) & F.col("left_row").eqNullSafe(F.col("right_row"))
    return rows.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("identical"))


def vintage_state(stored: DataFrame, upstream: Column | str) -> DataFrame:
    """Stamps of each metric and whether they must advance to the upstream release."""
    target = F.lit(upstream) if isinstance(upstream, str) else upstream
    stamp = F.nullif(F.col("vintage"), F.lit(""))
    rows = stored.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(stamp.isNull()).alias("unstamped"),
        F.min(stamp).alias("first_stamp"), F.max(stamp).alias("last_stamp"),
    )
    usable = F.nullif(target, F.lit("")).isNotNull()
    advance = usable & (
        (F.col("unstamped") > 0) | (F.col("first_stamp") != F.col("last_stamp")) | (F.col("last_stamp") != target)
    )
    return rows.select("*", F.coalesce(advance, F.lit(False)).alias("needs_advance"))


# --- changes ---------------------------------------------------------------------------------------
def last_wins(staged: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last by ``order``, or without an order the greatest by all its columns.

    Later operators take keys as unique: they put a key's years into a map, which refuses a second entry, and the
    integrity report counts double keys. So everything that is stored passes here.
    """
    row = F.struct(*[c for c in staged.columns if c not in keys and c != order])
    last = F.max(row) if order is None else F.max_by(row, F.struct(order, row))
    return staged.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")


def upsert(stored: DataFrame, staged: DataFrame, keys: list[str] = KEY, order: str | None = None) -> DataFrame:
    """Staged rows replace stored ones of the same key; of several staged rows the last by ``order`` counts."""
    fresh = last_wins(staged.select(*stored.columns, *([order] if order else [])), keys, order)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def replace_range(stored: DataFrame, staged: DataFrame, metrics: list[str], first: int, last: int,
                  order: str | None = None) -> DataFrame:
    """The metrics' rows of the range give way to the staged ones; a vanished value is gone."""
    inside = F.col("metric").isin(metrics) & F.col("year").between(first, last)
    fresh = staged.where(inside).select(*stored.columns, *([order] if order else []))
    return stored.where(~inside).unionByName(last_wins(fresh, KEY, order))


def advance_vintage(stored: DataFrame, metrics: list[str], first: int, last: int, vintage: str) -> DataFrame:
    """Rewrites only the stamp, and only where it differs."""
    stale = F.col("metric").isin(metrics) & F.col("year").between(first, last) & ~F.col("vintage").eqNullSafe(vintage)
    return stored.withColumn("vintage", F.when(stale, F.lit(vintage)).otherwise(F.col("vintage")))


def upsert_dimension(stored: DataFrame, staged: DataFrame) -> DataFrame:
    return upsert(stored, staged, ["entity"])


# --- derived state -----------------------------------------------------------------------------------
def metric_years(obs: DataFrame) -> DataFrame:
    """Years each metric has; a metric has few years, so the list is short."""
    return obs.groupBy("metric").agg(
        F.sort_array(F.collect_set("year")).alias("years"), F.min("year").alias("min_year"), F.max("year").alias("max_year")
    )


def all_years(obs: DataFrame) -> DataFrame:
    return obs.agg(F.sort_array(F.collect_set("year")).alias("years"))


def dataset_state(obs: DataFrame) -> DataFrame:
    """One row: count, newest stamps and the years of every metric."""
    per = obs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), F.max("fetched_at").alias("fetched"), F.max("vintage").alias("stamp"),
        F.sort_array(F.collect_set("year")).alias("years"),
    )
    return per.agg(
        F.sum("rows").alias("observation_count"), F.max("fetched").alias("max_fetched_at"),
        F.max("stamp").alias("max_vintage"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "years")))).alias("years"),
    )


def vintage_summary(obs: DataFrame) -> DataFrame:
    """Rows and retrieval times per metric and stamp, with a flag for metrics of several stamps."""
    rows = obs.groupBy("metric", "vintage").agg(
        F.count(F.lit(1)).alias("rows"), F.min("fetched_at").alias("first_fetched"), F.max("fetched_at").alias("last_fetched")
    )
    stamps = F.count(F.lit(1)).over(Window.partitionBy("metric"))
    return rows.withColumn("mixed", stamps > 1)


def year_signature(obs: DataFrame, years: list[int]) -> DataFrame:
    return obs.where(F.col("year").isin(years)).groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), F.min("vintage").alias("min_vintage"), F.max("vintage").alias("max_vintage")
    )


def fingerprint(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Last success, newest retrieval, count and run: changes whenever the data may have."""
    done = runs.where(F.col("status") == "success").agg(
        F.max("completed_at").alias("last_success"), F.max("run_id").alias("run_id")
    )
    data = obs.agg(F.count(F.lit(1)).alias("observation_count"), F.max("fetched_at").alias("max_fetched_at"))
    # Two one-row tables.
    return data.crossJoin(done)


def freshness(obs: DataFrame, runs: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """Age of the last successful run; fresh only while it is young and there is data."""
    last = runs.where(F.col("status") == "success").agg(F.max("completed_at").alias("last_success"))
    some = obs.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_data"))
    age = F.timestamp_diff("SECOND", F.col("last_success"), now) / 3600.0
    return last.crossJoin(some).select(
        "last_success", "has_data", age.alias("age_hours"),
        F.coalesce(F.col("has_data") & (age < ttl_hours), F.lit(False)).alias("fresh"),
    )


# --- versions ------------------------------------------------------------------------------------------
class PanelStore:
    """Observation table under ``root``: one folder per metric and version, and a manifest per version.

    Staged rows carry what STORE_SCHEMA names; ``fetched_at`` may be missing and is then null.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """Version and metric folders; at most one row per metric of the registry."""
        if not self._exists(f"{self.root}/manifest"):
            return -1, {}
        rows = self.spark.read.json(f"{self.root}/manifest", schema="version long, metric string, folder string")
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        latest = rows.agg(F.max("version")).first()[0]
        if latest is None:
            return -1, {}
        found = rows.where((F.col("version") == latest) & F.col("metric").isNotNull()).collect()
        return latest, {r.metric: r.folder for r in found}

    def read(self, version: int | None = None) -> DataFrame:
        _, folders = self.manifest(version)
        if not folders:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(*folders.values())

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if self._exists(path) else None

    def publish(self, version: int, staged: DataFrame, first: int, last: int, upstream: str | None = None,
                before_commit: Callable[[DataFrame], None] | None = None) -> dict[str, str]:
        """Replaces the range of changed metrics, advances stamps of the rest, then flips the manifest.

        ``before_commit`` gets the version's rows while the manifest is still the old one, so that what it writes is
        there whenever the version is. Replaying a version that is already current does nothing. Returns the action
        per metric.
        """
        current, folders = self.manifest()
        if version <= current:
            return {}
        stored = self.read()
        if "fetched_at" not in staged.columns:
            staged = staged.withColumn("fetched_at", F.lit(None).cast("timestamp"))
        staged = cut_lineage(staged)
        # A metric absent from the payload is left alone, so only staged metrics are judged.
        verdicts = metric_verdicts(
            stored.where(F.col("year").between(first, last)), staged.where(F.col("year").between(first, last))
        ).join(staged.select("metric").distinct(), "metric", "left_semi")
        unchanged = {r.metric: r.unchanged for r in verdicts.collect()}
        stale = set()
        if upstream:
            # Only the range is judged, as only the range is rewritten: older stamps outside it stay as they are.
            judged = vintage_state(stored.where(F.col("year").between(first, last)), upstream)
            stale = {r.metric for r in judged.where("needs_advance").collect()}
        changed = sorted(m for m, same in unchanged.items() if not same)
        advanced = sorted(m for m, same in unchanged.items() if same and m in stale)
        actions = dict.fromkeys(sorted(unchanged), "skipped") | dict.fromkeys(changed, "replaced") | dict.fromkeys(advanced, "advanced")
        fresh = dict(folders)
        if changed or advanced:
            # Only the folders of these metrics are read, and one job writes all of them.
            old = [folders[m] for m in (*changed, *advanced) if m in folders]
            mine = self.spark.read.schema(STORE_SCHEMA).parquet(*old) if old else stored.limit(0)
            rows = replace_range(mine, staged, changed, first, last) if changed else mine
            rows = advance_vintage(rows, advanced, first, last, upstream) if advanced else rows
            target = f"{self.root}/obs/v{version}"
            # Sorted within files by year: a year's rows sit in few row groups.
            dealt = rows.withColumn("_of", F.col("metric")).repartition("_of", "year").sortWithinPartitions("_of", "year", "entity")
            dealt.write.mode("overwrite").partitionBy("_of").parquet(target)
            # A metric whose rows all vanished has no folder any more.
            left = {r.metric for r in self.spark.read.schema(STORE_SCHEMA).parquet(target).select("metric").distinct().collect()}
            for metric in (*changed, *advanced):
                fresh.pop(metric, None)
            fresh |= {metric: f"{target}/_of={metric}" for metric in left}
        if before_commit:
            none = self.spark.createDataFrame([], STORE_SCHEMA)
            before_commit(self.spark.read.schema(STORE_SCHEMA).parquet(*fresh.values()) if fresh else none)
        lines = [(version, m, f) for m, f in fresh.items()]
        lines = lines or [(version, None, None)]  # an empty version is a version
        self.spark.createDataFrame(lines, "version long, metric string, folder string").coalesce(1).write.mode(
            "append"
        ).json(f"{self.root}/manifest")
        return actions

    def put(self, name: str, version: int, rows: DataFrame) -> None:
        """A run's own side table. Written before the manifest and rewritten on replay; readers trust
        only runs up to the current version."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={version}")

    def side_table(self, name: str) -> DataFrame | None:
        rows = self.table(name)
        return None if rows is None else rows.where(F.col("run_id") <= self.manifest()[0])
