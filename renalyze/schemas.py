"""Canonical table schemas."""

from pyspark.sql import types as T

PATIENTS = T.StructType([
    T.StructField("mrn", T.StringType(), False),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("sex", T.StringType(), True),
])

MEASUREMENTS = T.StructType([
    T.StructField("mrn", T.StringType(), False),
    T.StructField("creatinine_date", T.TimestampType(), False),
    T.StructField("creatinine_result", T.DoubleType(), True),
])

HL7_RAW = T.StructType([
    T.StructField("msg_id", T.LongType(), False),
    T.StructField("raw", T.StringType(), True),
])

# One parsed OBX row inside a message.
TEST_STRUCT = T.StructType([
    T.StructField("obx_pos", T.IntegerType(), False),
    T.StructField("mrn", T.LongType(), True),
    T.StructField("test_value", T.DoubleType(), True),
    T.StructField("test_time", T.StringType(), True),
])

FEATURE_COLUMNS = [
    "creatinine_mean", "creatinine_median", "creatinine_max", "creatinine_min",
    "creatinine_max_delta", "creatinine_std", "most_recent", "rv1_ratio",
    "rv2_ratio",
]

# Allowed values of Patients.sex (the table's ENUM).
SEX_VALUES = ["M", "F", "Other"]

# Quarantine reasons, in the order checks are applied.
REASONS = [
    "bad_mrn", "unknown_type", "no_mrn", "no_demographics", "no_result",
    "unknown_patient", "bad_framing", "trailing_data", "bad_date", "bad_sex",
]
