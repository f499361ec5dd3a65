"""Declared schemas of the two fact tables (§1.4)."""
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampNTZType

_S, _D, _T = StringType(), DateType(), TimestampNTZType()

METERS = StructType([StructField(n, t) for n, t in [
    ("project", _S), ("discom", _S), ("zone", _S), ("circle", _S), ("division", _S), ("subdivision", _S),
    ("substation", _S), ("feeder", _S), ("dtr", _S), ("metertype", _S), ("connection_type", _S),
    ("consumerno", _S), ("meterserialnumber", _S), ("technicianname", _S), ("supervisor", _S),
    ("didate", _D), ("mi_date", _D), ("installedts", _T), ("sat_no", _S), ("sat_date", _D),
    ("gmrtoagencyts", _T), ("agencytosupts", _T), ("lumpsum_invoice_date", _D), ("pmpm_invoice_date", _D),
    ("lumpsum_collection_date", _D), ("pmpm_collection_date", _D),
]])

COMPLAINTS = StructType([StructField(n, t) for n, t in [
    ("ticket_id", _S), ("project", _S), ("discom", _S), ("zone", _S), ("circle", _S), ("division", _S),
    ("sub_division", _S), ("feeder", _S), ("dtr", _S), ("meter_category", _S), ("technician", _S),
    ("supervisor", _S), ("created_date", _T), ("closed_date", _T), ("agency", _S), ("complaint_by", _S),
    ("complaint_type", _S), ("complaint_category", _S), ("old_smart_meter_number", _S),
    ("new_smart_meter_number", _S),
]])


def rows_to_df(spark, schema: StructType, rows: list[dict]):
    """Small hand-made frames for tests: unspecified columns are null."""
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
