"""Parquet stages. Every stage writes its own folder and never one that it reads."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.errors import SourceError, StageError
from cohortloom.params import RawPaths
from cohortloom.sources import raw


@dataclass(frozen=True)
class StagePaths:
    """Folder layout below one root."""

    root: str

    def bronze(self, table: str) -> str:
        return f"{self.root}/bronze/{table}"

    def silver(self, table: str = "notes") -> str:
        return f"{self.root}/silver/{table}"

    def gold(self, table: str) -> str:
        return f"{self.root}/gold/{table}"

    def report(self, table: str) -> str:
        return f"{self.root}/reports/{table}"


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace one stage table."""
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_stage(spark: SparkSession, path: str, made_by: str) -> DataFrame:
    """Read a stage table, or say which stage has to run first."""
    if not raw.path_exists(spark, path):
        raise StageError(f"{path} is missing: run the {made_by} stage first")
    return spark.read.parquet(path)


def bronze_ingest_stamp(df: DataFrame) -> DataFrame:
    """Add the time of ingestion."""
    return df.withColumn("_ingested_at", F.current_timestamp())


def write_bronze(
    spark: SparkSession, paths: RawPaths, stages: StagePaths, stamp: bool = False
) -> list[str]:
    """Mirror the raw tables as Parquet; returns the names of the tables written.

    Values that cannot be read show while a table is written; they are the fault of its source.
    """
    tables = {
        "discharge_notes": raw.read_notes(spark, paths.notes),
        "diagnoses_icd": raw.read_diagnoses(spark, paths.diagnoses),
        "admissions": raw.read_admissions(spark, paths.admissions),
        "patients": raw.read_patients(spark, paths.patients),
        "d_icd_diagnoses": raw.read_code_dictionary(spark, paths.code_dictionary),
    }
    present = {name: df for name, df in tables.items() if df is not None}
    for name, df in present.items():
        try:
            write_stage(bronze_ingest_stamp(df) if stamp else df, stages.bronze(name))
        except (PySparkException, Py4JJavaError) as broken:
            raise SourceError(f"cannot read the raw files of {name}") from broken
    return list(present)


def write_silver(notes: DataFrame, stages: StagePaths) -> None:
    write_stage(notes, stages.silver())


def write_gold_labels(
    cohort: DataFrame, label_rows: DataFrame, label_names: DataFrame, stages: StagePaths
) -> None:
    """Persist the cohort notes, the positive label cells and the ordered label list."""
    write_stage(cohort, stages.gold("notes"))
    write_stage(label_rows, stages.gold("labels"))
    write_stage(label_names, stages.gold("label_names"))


def load_gold(spark: SparkSession, stages: StagePaths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cohort notes, positive label cells and label list as ``write_gold_labels`` left them."""
    names = ("notes", "labels", "label_names")
    cohort, cells, labels = (read_stage(spark, stages.gold(n), "gold") for n in names)
    return cohort, cells, labels


def write_splits(manifest: DataFrame, stages: StagePaths) -> None:
    """Persist the manifest so that one split is one folder."""
    write_stage(manifest, stages.gold("splits"), partition_by="split")


def load_splits(spark: SparkSession, stages: StagePaths) -> DataFrame:
    return read_stage(spark, stages.gold("splits"), "splits")


def write_thresholds(thresholds: DataFrame, stages: StagePaths) -> None:
    write_stage(thresholds, stages.gold("thresholds"))


def load_thresholds(spark: SparkSession, stages: StagePaths) -> DataFrame:
    return read_stage(spark, stages.gold("thresholds"), "train")


def write_error_tables(per_label: DataFrame, pairs: DataFrame, stages: StagePaths) -> None:
    """Persist the two report tables of the error analysis."""
    write_stage(per_label, stages.report("per_label"))
    write_stage(pairs, stages.report("confusion_pairs"))
