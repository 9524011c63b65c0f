"""Landed payload files: paged ``[meta, rows]`` envelopes, one JSON document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

META = "page int, pages int, per_page int, total long, sourceid string, lastupdated string"
ROW = (
    "indicator struct<id:string,value:string>, country struct<id:string,value:string>, countryiso3code string,"
    "date string, value string, unit string, obs_status string, `decimal` int"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file, with its status: ``ok``, ``api_error`` or ``malformed``.

    A file is one page of the source, so its size is the source's page size whatever the volume.
    """
    text = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )
    return parse_pages(text)


def parse_pages(text: DataFrame) -> DataFrame:
    """``text`` has file and body columns."""
    parts = F.from_json("body", "array<string>")
    rows = text.select("file", parts.alias("parts"))
    rows = rows.select(
        "file", "parts",
        F.from_json(F.get("parts", F.lit(0)), META).alias("meta"),
        F.from_json(F.get("parts", F.lit(1)), f"array<struct<{_struct(ROW)}>>").alias("rows"),
        F.get_json_object(F.get("parts", F.lit(0)), "$.message").alias("message"),
    )
    is_error = (F.size("parts") == 1) & F.col("message").isNotNull()
    is_page = (F.size("parts") >= 2) & F.col("meta").isNotNull() & F.col("rows").isNotNull()
    status = F.when(is_error, "api_error").when(F.coalesce(is_page, F.lit(False)), "ok").otherwise("malformed")
    return rows.select("file", "meta", "rows", "message", status.alias("status"))


def _struct(ddl: str) -> str:
    out, depth, start = [], 0, 0
    for at, ch in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            name, kind = ddl[start:at].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = at + 1
    return ",".join(out)


def rejected_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status") != "ok").select("file", "status", "message")


#: A payload is one release of one indicator: its pages name the same release and the same total.
PAYLOAD = ["indicator", "vintage", "declared"]


def keyed_pages(pages: DataFrame) -> DataFrame:
    """Good pages with the key of the payload they belong to."""
    return pages.where(F.col("status") == "ok").select(
        F.get("rows", F.lit(0))["indicator"]["id"].alias("indicator"), F.col("meta.lastupdated").alias("vintage"),
        F.col("meta.total").alias("declared"), "file", "meta", "rows", "message", "status",
    )


def payload_rows(pages: DataFrame, metric_codes: DataFrame) -> DataFrame:
    """Observations in the shape classification takes; ``landed`` orders them by page and place in the page."""
    good = pages.where(F.col("status") == "ok")
    rows = good.select("file", "meta.page", F.col("meta.lastupdated").alias("vintage"), F.posexplode("rows").alias("at", "r"))
    rows = rows.select(
        F.col("r.indicator.id").alias("indicator"), F.col("r.countryiso3code").alias("code"),
        F.col("r.date").alias("date"), F.col("r.value").alias("value_text"), "vintage",
        F.struct("page", "at", "file").alias("landed"),
    )
    return rows.join(metric_codes, "indicator").drop("indicator")


def newest_files(keyed: DataFrame) -> DataFrame:
    """One file for each page of a payload, the newest by name; a page without a number is one of its own."""
    page = F.coalesce(F.col("meta.page").cast("string"), F.col("file"))
    rows = F.size("rows").cast("long")
    return keyed.groupBy(*PAYLOAD, page.alias("page")).agg(F.max("file").alias("file"), F.max_by(rows, "file").alias("rows"))


def page_completeness(pages: DataFrame) -> DataFrame:
    """Rows reconstructed from all pages of a payload against the total it declared, and its newest file.

    A page that landed twice counts once.
    """
    sums = newest_files(keyed_pages(pages)).groupBy(*PAYLOAD).agg(
        F.sum("rows").alias("received"), F.count(F.lit(1)).alias("pages"), F.max("file").alias("newest")
    )
    declared, received = F.col("declared"), F.col("received")
    status = F.when(declared.isNull(), "unknown").when(declared == received, "complete").otherwise("mismatch")
    return sums.select("*", status.alias("status"), (declared - received).alias("missing_rows"))
