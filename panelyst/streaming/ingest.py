"""Incremental ingest: landed payload files through classification and diff into the panel store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelyst.operators.classify import classify_observations, rejection_counters, staged
from panelyst.session import cut_lineage
from panelyst.sources.payloads import PAYLOAD, keyed_pages, newest_files, page_completeness, parse_pages, payload_rows, rejected_pages
from panelyst.sources.publish import KEY, PanelStore, dataset_state, last_wins

RUN = "status string, pages_fetched long, requests long, has_snapshot boolean, completed_at timestamp"


def _waiting(store: PanelStore, pages: DataFrame, version: int) -> DataFrame:
    """Pages of this batch and those earlier batches held back: landed, and not yet part of a published payload."""
    store.put("landed_pages", version, pages)
    landed = store.table("landed_pages").where(F.col("run_id") <= version).drop("run_id")
    taken = store.side_table("taken_files")
    return landed if taken is None else landed.join(taken.select("file"), "file", "left_anti")


def _chosen(waiting: DataFrame) -> DataFrame:
    """Keys of payloads that are whole, with whether each is its indicator's newest."""
    whole = page_completeness(waiting).where("status != 'mismatch'")
    newest = whole.groupBy("indicator").agg(F.max(F.struct("vintage", "newest")).alias("_last"))
    is_last = F.struct("vintage", "newest").eqNullSafe(F.col("_last"))
    return whole.join(newest, "indicator").select(*PAYLOAD, is_last.alias("is_newest"))


def ingest_batch(store: PanelStore, pages: DataFrame, dim: DataFrame, metric_codes: DataFrame, version: int,
                 first: int, last: int) -> dict[str, str]:
    """One atomic refresh: payloads that are whole are published, the newest of each indicator; others wait.

    A page that is broken or an error is recorded and holds back nothing but its own payload. Every batch leaves a
    run row, also one that fails; the counters, the snapshot and the state row belong to its version.
    """
    if version <= store.manifest()[0]:
        return {}
    pages = cut_lineage(pages)
    try:
        store.put("rejected_pages", version, rejected_pages(pages))
        waiting = cut_lineage(_waiting(store, pages, version))
        chosen = cut_lineage(_chosen(waiting))
        keyed = keyed_pages(waiting)
        match = [keyed[k].eqNullSafe(chosen[k]) for k in PAYLOAD]
        whole = cut_lineage(keyed.join(chosen, match).select(*[keyed[c] for c in keyed.columns], "is_newest"))
        # All files of a whole payload are taken; of a page that landed twice only the newest is read.
        pages_once = whole.join(newest_files(whole).select("file"), "file", "left_semi")
        rows = payload_rows(pages_once.where("is_newest"), metric_codes)
        classified = cut_lineage(classify_observations(rows, dim))
        upstream = classified.agg(F.max("vintage")).first()[0]
        store.put("taken_files", version, whole.select("file").distinct())
        store.put("ingest_year_stats", version, rejection_counters(classified))
        store.put("run_universe", version, dim.select("entity", "is_aggregate"))
        counts = pages_once.agg(F.count_if("is_newest").alias("fetched")).first()["fetched"]
        store.put("runs", version, _run(store, "success" if counts else "held", counts, pages.count()))
        # Of a key that a payload holds twice the last row counts, before anything is compared.
        fresh = last_wins(staged(classified, "landed"), KEY, "landed").withColumn("fetched_at", F.current_timestamp())
        # The manifest written by this call is the one commit point of the batch, after everything else of the version.
        return store.publish(
            version, fresh, first, last, upstream, before_commit=lambda rows: store.put("dataset_state", version, dataset_state(rows))
        )
    except Exception:
        store.put("runs", version, _run(store, "failed", 0, 0))
        raise


def _run(store: PanelStore, status: str, fetched: int, requests: int) -> DataFrame:
    """The run's own row. A page is one request."""
    row = store.spark.createDataFrame([(status, fetched, requests, fetched > 0, None)], RUN)
    return row.withColumn("completed_at", F.current_timestamp())


def start_ingest(spark: SparkSession, landing: str, store: PanelStore, dim: DataFrame, metric_codes: DataFrame, *,
                 first: int, last: int, checkpoint: str) -> StreamingQuery:
    """A file-source stream. The batch id is the table version, so a replayed batch changes nothing."""
    text = (
        spark.readStream.format("text").option("wholetext", "true").load(landing)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    )

    def publish(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(store, parse_pages(batch), dim, metric_codes, batch_id, first, last)

    return (
        text.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
