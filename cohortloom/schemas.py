"""Explicit schemas of the raw tables (no inference pass over compressed text)."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STR, _LONG, _INT, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()

NOTES = _schema(
    ("note_id", _STR), ("subject_id", _LONG), ("hadm_id", _LONG), ("note_type", _STR),
    ("note_seq", _INT), ("charttime", _TS), ("text", _STR),
)
DIAGNOSES = _schema(
    ("subject_id", _LONG), ("hadm_id", _LONG), ("seq_num", _INT),
    ("icd_code", _STR), ("icd_version", _INT),
)
ADMISSIONS = _schema(
    ("subject_id", _LONG), ("hadm_id", _LONG), ("admittime", _TS), ("dischtime", _TS),
    ("deathtime", _TS), ("hospital_expire_flag", _INT), ("admission_type", _STR), ("race", _STR),
    ("insurance", _STR), ("language", _STR), ("discharge_location", _STR),
)
PATIENTS = _schema(
    ("subject_id", _LONG), ("gender", _STR), ("anchor_age", _INT), ("anchor_year", _INT),
    ("anchor_year_group", _STR), ("dod", _TS),
)
CODE_DICTIONARY = _schema(("icd_code", _STR), ("icd_version", _INT), ("long_title", _STR))
