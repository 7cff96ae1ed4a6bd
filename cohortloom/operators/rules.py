"""Rules of the sensitive-text scan, as data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------------
# Patterns, severities and scopes of the rules. Matching ignores case.
# ---------------------------------------------------------------------------------------------

SECTION_HEADERS = (
    r"Admission\s+Date\s*:",
    r"Discharge\s+Date\s*:",
    r"Chief\s+Complaint\s*:",
    r"History\s+of\s+Present\s+Illness",
    r"Past\s+Medical\s+History",
    r"Hospital\s+Course\s*:",
    r"Discharge\s+Diagnosis",
    r"Discharge\s+Medications",
    r"Physical\s+Exam\s*:",
    r"Allergies?\s*:",
    r"Service\s*:\s*MEDICINE",
    r"Service\s*:\s*SURGERY",
    r"Review\s+of\s+Systems",
    r"Major\s+Surgical\s+or\s+Invasive\s+Procedure",
    r"Brief\s+Hospital\s+Course",
    r"Pertinent\s+Results\s*:",
    r"Facility\s*:",
)
PHI_MARKERS = (
    r"\bMRN\s*[:#]",
    r"\bSSN\s*[:#]?",
    r"\bDOB\s*[:#]?",
    r"Patient\s+is\s+a\s+\d+",
    r"\b\d+\s*(?:yo|y\.?o\.?|year[- ]old)\b",
    r"\(\d{3}\)\s*\d{3}-\d{4}",
    r"\b\d{3}-\d{3}-\d{4}\b",
)
REDACTION_LEAKS = (
    r"_{4,}",
    r"\[\*\*[^\]]{1,120}\*\*\]",
    r"\[\*\*Hospital\s+\d+\*\*\]",
    r"\[\*\*Known\s+(?:first|last)name[^\]]*\*\*\]",
)
RAW_PATHS = (
    r"[/\\]data[/\\]physionet",
    r"physionet[/\\]mimic",
    r"mimic-iv-note[/\\]note[/\\]",
    r"mimic-iv[/\\]hosp[/\\]",
    r"[A-Za-z]:[/\\]data[/\\]physionet",
    r"physionet\.org[/\\]files[/\\]mimic",
)
DISPLAY_SETTINGS = (
    r"display\.max_colwidth[\"']?\s*,\s*(?:None|-?\s*1\b)",
    r"set_option\(\s*[\"']display\.max_colwidth[\"']\s*,\s*(?:None|-?\s*1\b)",
    r"set_option\(\s*[\"']display\.max_rows[\"']\s*,\s*None",
)

# category, severity, patterns, locations, kinds
RULE_GROUPS = (
    ("clinical_text", "CRITICAL", SECTION_HEADERS, ("source", "output"), ("code", "markdown", "raw")),
    ("phi_marker", "CRITICAL", PHI_MARKERS, ("source", "output"), ("code", "markdown", "raw")),
    ("mimic_redaction_leak", "HIGH", REDACTION_LEAKS, ("output",), ("code",)),
    ("raw_data_path", "HIGH", RAW_PATHS, ("source",), ("code", "markdown", "raw")),
    ("dangerous_display_setting", "MEDIUM", DISPLAY_SETTINGS, ("source",), ("code",)),
)

CLINICAL_WORDS = (
    r"\b(?:admitted|prescribed|presented|reported|complained|denied|"
    r"tolerated|discharged\s+home|transferred|followed[- ]up|"
    r"status\s+post|s\s*/\s*p\b|chief\s+complaint|brief\s+hospital\s+course|"
    r"past\s+medical\s+history|history\s+of\s+present|review\s+of\s+systems|"
    r"physical\s+exam|pertinent\s+results|social\s+history|family\s+history|"
    r"medications?\s+on\s+admission|medications?\s+on\s+discharge)\b"
)

# The coarse audit: categories in the order they are tried, each with its patterns in order.
AUDIT_GROUPS = (
    (
        "clinical_section_header",
        (
            r"Admission\s+Date\s*:",
            r"Discharge\s+Date\s*:",
            r"Chief\s+Complaint\s*:",
            r"History\s+of\s+Present\s+Illness",
            r"Past\s+Medical\s+History",
            r"Hospital\s+Course\s*:",
            r"Discharge\s+Diagnosis",
            r"Physical\s+Exam\s*:",
            r"Pertinent\s+Results\s*:",
            r"Brief\s+Hospital\s+Course",
        ),
    ),
    ("phi_marker", PHI_MARKERS),
    ("mimic_redaction_leak", (r"_{5,}", r"\[\*\*[A-Za-z0-9 ,./-]{1,120}\*\*\]")),
    (
        "raw_data_path",
        (
            r"[/\\]data[/\\]physionet",
            r"[A-Za-z]:[/\\]data[/\\]physionet",
            r"physionet\.org[/\\]files[/\\]mimic",
        ),
    ),
)
# ---------------------------------------------------------------------------------------------


def required_literal(pattern: str) -> str:
    """The longest plain run of characters that every match of a rule contains, in lower case.

    Empty if there is none of at least three characters. Groups, classes, escapes, counts and
    optional characters do not belong to a run.
    """
    gap = "\0"
    plain = re.sub(r"\\.|\(\?:[^)]*\)|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}", gap, pattern)
    plain = re.sub(r".[?*]", gap, plain)
    runs = re.findall(r"[A-Za-z_-]{3,}", plain)
    return max(runs, key=len, default="").lower()


@dataclass(frozen=True)
class Rule:
    rule_id: int
    category: str
    severity: str
    pattern: str
    locations: tuple[str, ...]
    kinds: tuple[str, ...]

    @property
    def java_pattern(self) -> str:
        """The pattern with the flags that give it the meaning it has on Unicode text."""
        return "(?iU)" + self.pattern


def phi_rules() -> list[Rule]:
    """All rules, numbered in order."""
    rules: list[Rule] = []
    for category, severity, patterns, locations, kinds in RULE_GROUPS:
        for pattern in patterns:
            rules.append(Rule(len(rules), category, severity, pattern, locations, kinds))
    return rules


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as a table."""
    rows = [
        (r.rule_id, r.category, r.severity, r.pattern, list(r.locations), list(r.kinds))
        for r in phi_rules()
    ]
    schema = (
        "rule_id int, category string, severity string, pattern string, "
        "locations array<string>, kinds array<string>"
    )
    return spark.createDataFrame(rows, schema)
