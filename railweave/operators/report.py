"""Reports on timetable files: clean-up and roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the report, in order, and statuses that mean a file can't be used.
REPORT_COLUMNS = ("source", "province_code", "dataset_id", "dataset_name", "transport_types", "file_id", "file_name", "status", "dataset", "mode", "routes", "stops", "edges", "error")
FAILED = ("failed", "failed_processing")
USABLE = ("written", "nothing_in_area", "skipped_mode", "no_service_on_date", "not_requested_type")


def first_of_file(report: DataFrame, order: str = "reported_at") -> DataFrame:
    """One row per file: the earliest reported, as a file that several provinces list is one file."""
    return report.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min_by(F.struct(*[c for c in report.columns if c != "file_id"]), F.struct(order, F.coalesce("province_code", F.lit(-1)))).alias("r")).select("file_id", "r.*")


def dataset_outcomes(report: DataFrame) -> DataFrame:
    """``(dataset_id, n_files, n_failed, unusable)``: a dataset is unusable if some file failed and none could be used."""
    by = report.groupBy("dataset_id").agg(F.count_distinct("file_id").alias("n_files"), F.count_distinct(F.when(F.col("status").isin(*FAILED), F.col("file_id"))).alias("n_failed"), F.coalesce(F.max(F.col("status").isin(*USABLE)), F.lit(False)).alias("_some"))
    return by.select("dataset_id", "n_files", "n_failed", ((F.col("n_failed") > 0) & ~F.col("_some")).alias("unusable"))


def dataset_name(file_name):
    """A dataset's name from its file's: without folder stamp ``YYYYMMDD_HHMMSS_`` and ending, lower case, ``_`` for blanks."""
    base = F.regexp_replace(F.regexp_replace(file_name, r"^\d{8}_\d{6}_", ""), r"(?i)\.zip$", "")
    return F.lower(F.regexp_replace(F.trim(base), r"[^0-9A-Za-z]+", "_"))
