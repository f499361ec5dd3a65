"""File sources: staging tables and CSV extracts (S3-S8, S11), read with
declared all-string schemas (no inference pass over the data) and parsed with
built-in date functions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import col

DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy")


def parse_mixed_date(c, formats=DEFAULT_DATE_FORMATS) -> Column:
    """First format that parses wins; unparsable -> null (try_ under ANSI)."""
    return F.coalesce(*[F.try_to_date(col(c), fmt) for fmt in formats])


def installation_staging(df: DataFrame) -> DataFrame:
    """S3: installation staging frame with a parsed installation date."""
    return df.withColumn("installation_date", parse_mixed_date("installationDate"))


def read_installation_staging(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S3: read the installation staging file (all strings) and parse its date."""
    return installation_staging(spark.read.format(fmt).option("header", "true").option("mode", "PERMISSIVE").load(path))


def inventory_staging(df: DataFrame, project_col: str = "project") -> DataFrame:
    """Inventory staging: project alias, parsed DI date and installed date."""
    return df.select(*[c for c in df.columns],
                     F.col(project_col).alias("project_name"),
                     parse_mixed_date("DIDate").alias("didate"),
                     parse_mixed_date("InstalledTS").alias("installed_date"))


# Complaint CSVs -------------------------------------------------------------
COMPLAINT_CSV_RENAMES = {"FeederName": "Feeder", "DTRName": "DTR", "complaintBy": "ComplaintBy"}
CLOSED_ONLY_COLUMNS = ["ClosedDate", "NewSmartMeterNumber", "ComplaintCategory"]
#: Tried in turn after the ISO forms.
COMPLAINT_TIME_FORMATS = ("dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")


def parse_mixed_timestamp(c, formats=COMPLAINT_TIME_FORMATS) -> Column:
    """S6 for times: ISO, else the first format that parses; unparsable -> null."""
    return F.coalesce(F.try_to_timestamp(col(c)), *[F.try_to_timestamp(col(c), F.lit(f)) for f in formats])


def complaint_frame(df: DataFrame, category: str, status: str, formats=COMPLAINT_TIME_FORMATS) -> DataFrame:
    """S5 (one frame of strings): variant headers renamed, columns that only
    closed files have set to typed nulls in all others, tagged with category
    and status, dates parsed. A frame without CreatedDate is an error."""
    if "CreatedDate" not in df.columns:
        raise ValueError("complaint file without CreatedDate")
    for old, new in COMPLAINT_CSV_RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if status != "closed":
        df = df.withColumns({c: F.lit(None).cast("string") for c in CLOSED_ONLY_COLUMNS})
    return df.withColumns({"MeterCategory": F.lit(category), "status": F.lit(status),
                           "created_date": parse_mixed_timestamp("CreatedDate", formats),
                           "closed_date": parse_mixed_timestamp("ClosedDate", formats)})


def read_complaint_csv(spark: SparkSession, path: str, category: str, status: str,
                       header: list[str] | None = None, formats=COMPLAINT_TIME_FORMATS) -> DataFrame:
    """S5 (one file): all-string read, then :func:`complaint_frame`."""
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    if header:
        reader = reader.schema(StructType([StructField(h, StringType()) for h in header]))
    return complaint_frame(reader.csv(path), category, status, formats)


def align_and_concat(frames: list[DataFrame]) -> DataFrame:
    """Keep the columns common to all frames (first frame's order) and concatenate."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def read_complaint_files(spark: SparkSession, files: dict) -> DataFrame:
    """{category: {'closed': path, 'open': path}} -> one aligned frame."""
    frames = [read_complaint_csv(spark, p, cat, st) for cat, d in files.items() for st, p in d.items()]
    return align_and_concat(frames)


def enrich_time(df: DataFrame, created="created_date", closed="closed_date") -> DataFrame:
    """Day, ISO week start and month label 'Mon YYYY' of created and closed."""
    parts = {}
    for name, c in (("created", created), ("closed", closed)):
        parts |= {f"{name}_day": F.to_date(col(c)), f"{name}_week": F.to_date(F.trunc(F.to_date(col(c)), "week")),
                  f"{name}_month": F.date_format(col(c), "MMM yyyy")}
    return df.select(*df.columns, *[x.alias(n) for n, x in parts.items()])


GEO_MAP_COLUMNS = ["meter_serial_number", "discom", "zone", "circle", "division", "subdivision"]


def clean_geo_mapping(raw: DataFrame) -> DataFrame:
    """Trim headers and cells (all strings), keep rows whose five geo
    columns are all non-empty."""
    df = raw.toDF(*[c.strip() for c in raw.columns])
    df = df.select(*[F.trim(F.col(c)).alias(c) if c == "meter_serial_number"
                     else F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in GEO_MAP_COLUMNS])
    keep = reduce(lambda a, b: a & b, [F.col(c) != "" for c in GEO_MAP_COLUMNS[1:]])
    return df.where(keep)


def read_geo_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raw rows, usable rows) of the remediation CSV."""
    raw = spark.read.option("header", "true").csv(path)
    return raw, clean_geo_mapping(raw)
