"""The profiling report: every analysis as one small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import coverage as cv
from cohortloom.operators import profile as pf
from cohortloom.operators.labels import label_cooccurrence
from cohortloom.session import cut_lineage, spread
from cohortloom.sources.stages import StagePaths, read_stage, write_stage


def profile_tables(
    notes: DataFrame,
    diagnoses: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    dictionary: DataFrame | None = None,
    version: int = 10,
) -> dict[str, DataFrame]:
    """All analyses in report order, by name."""
    tables = {
        "notes": notes, "diagnoses": diagnoses, "admissions": admissions, "patients": patients,
    }
    if dictionary is not None:
        tables["icd_diagnoses"] = dictionary
    # the texts are measured once; the reports below read three numbers per note
    lengths = cut_lineage(pf.marker_counts(spread(notes)), "lengths")
    # what several reports read is merged once: it takes a shuffle of all codes or admissions each
    counts = cut_lineage(pf.code_counts(diagnoses, version), "code-counts")
    per_admission = cut_lineage(pf.codes_per_admission(diagnoses, version), "codes-per-admission")
    per_patient = cut_lineage(pf.admissions_per_patient(admissions), "admissions-per-patient")
    at_version = diagnoses.filter(F.col("icd_version") == version)
    losses = cut_lineage(cv.cohort_coverage(notes, admissions, at_version), "cohort-coverage")
    by_year = cut_lineage(pf.icd_version_by_year(diagnoses, admissions), "versions-by-year")
    report = {"volumetrics": pf.summarize_volumetrics(tables)}
    for name, df in tables.items():
        report[f"null_rates_{name}"] = pf.null_rate_by_column(df, name)
    for name, df in (("notes", notes), ("admissions", admissions)):
        for column in ("charttime", "storetime", "admittime", "dischtime"):
            if column in df.columns:
                report[f"date_range_{name}_{column}"] = pf.date_range(df, column)
    report |= {
        "note_types": pf.note_type_distribution(notes),
        "length_percentiles": pf.length_percentiles(lengths),
        "truncation": pf.truncation_impact(lengths),
        "length_histogram": pf.equal_width_histogram(lengths, "n_tokens"),
        "deid_markers": pf.marker_stats_of(lengths),
        "duplication": pf.note_duplication_summary(notes),
        "versions": pf.icd_version_distribution(diagnoses),
        "versions_by_year": by_year.orderBy("year", "icd_version"),
        "version_year_pivot": pf.version_year_pivot(by_year),
        "frequency": pf.icd_frequency(diagnoses, version, counts),
        "top_k_coverage": pf.top_k_coverage(diagnoses, (*pf.COVERAGE_K, 2500), version, counts),
        "codes_per_admission": pf.codes_per_admission_stats(per_admission),
        "codes_per_admission_histogram": pf.capped_histogram(per_admission, "n_codes", 40),
        "cooccurrence": label_cooccurrence(diagnoses, 20, version, counts),
        "demographics": pf.patient_demographics(patients),
        "admissions_per_patient": pf.admissions_per_patient_stats(per_patient),
        "admissions_per_patient_histogram": pf.capped_histogram(per_patient, "n_admissions", 20),
        "length_of_stay": pf.los_summary(admissions),
        "mortality": pf.mortality_rate(admissions),
        "cohort_demographics": pf.cohort_demographics(notes, admissions, diagnoses, patients, version),
        "join_coverage": cv.join_coverage(notes, admissions, diagnoses, version),
        "version_reconciliation": cv.version_reconciliation(notes, admissions),
        "cohort_coverage": losses,
        "total_cohort_loss": cv.total_cohort_loss(losses),
    }
    if dictionary is not None:
        report["top_codes"] = pf.top_code_table(diagnoses, dictionary, 50, version, counts)
    return report


def run_eda(spark: SparkSession, stages: StagePaths, version: int = 10) -> list[str]:
    """Write every analysis over the bronze tables below the report folder."""
    names = ("discharge_notes", "diagnoses_icd", "admissions", "patients")
    inputs = [read_stage(spark, stages.bronze(n), "bronze") for n in names]
    from cohortloom.sources.raw import path_exists

    has_titles = path_exists(spark, stages.bronze("d_icd_diagnoses"))
    titles = read_stage(spark, stages.bronze("d_icd_diagnoses"), "bronze") if has_titles else None
    report = profile_tables(*inputs, dictionary=titles, version=version)
    for name, df in report.items():
        write_stage(df, stages.report(f"eda_{name}"))
    return list(report)
