"""Sensitive-text scan: every rule against every text in one projection.

The operators read ``(doc_id, text)`` and work on batch and streaming tables alike.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import NOT_SPACE, caseless, match_start, redacted_context
from cohortloom.operators.rules import (
    AUDIT_GROUPS,
    CLINICAL_WORDS,
    Rule,
    phi_rules,
    required_literal,
)
from cohortloom.operators.tables import computed_once

# Fixed values of the prose test.
MIN_PROSE_CHARS = 1500
MIN_PROSE_WORDS = 5
MIN_WORDS_PER_LINE = 12
MAX_PADDING_PER_1000 = 2
MIN_SENTENCE_BREAKS = 4

# Number of the finding that no pattern makes; those of the patterns start at 1.
PROSE_RULE = 0


def _fires(text: Column, pattern: str) -> Column:
    """Whether a pattern matches; most texts are ruled out by a plain search in ``_low``."""
    literal = required_literal(pattern)
    match = text.rlike("(?iU)" + pattern)
    return F.contains(F.col("_low"), F.lit(literal)) & match if literal else match


def _finding(text: Column, rule: Rule, window: int) -> Column:
    """Null without a match; otherwise the rule, the place and the redacted surroundings."""
    pattern = rule.java_pattern
    start = match_start(text, pattern)
    length = F.length(F.regexp_substr(text, F.lit(pattern)))
    return F.when(
        _fires(text, rule.pattern),
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.severity).alias("severity"),
            start.alias("start"),
            length.alias("length"),
            redacted_context(text, start, length, window).alias("context"),
        ),
    )


def phi_scan(
    docs: DataFrame,
    location: str = "output",
    kind: str = "code",
    rules: Sequence[Rule] | None = None,
    key: str = "doc_id",
    window: int = 40,
) -> DataFrame:
    """At most one finding per rule and text, the first match.

    Only rules for the given location and kind of text are tried. An output that reads like the body of a
    note is a finding as a whole. The text stays behind: a finding carries nothing but its redacted
    surroundings.
    """
    tried = [
        r for r in (phi_rules() if rules is None else rules)
        if location in r.locations and kind in r.kinds
    ]
    text = F.col("text")
    findings = [_finding(text, r, window) for r in tried]
    low = computed_once(docs.select(key, "text"), _low=caseless(text))
    if location == "output":
        # only long texts are measured; each measure once
        measures = F.struct(*[m.alias(name) for name, m in _prose_measures(text).items()])
        low = computed_once(low, _prose=F.when(F.length(text) >= MIN_PROSE_CHARS, measures))
        findings.append(_prose_finding(text, F.col("_prose")))
    hits = F.filter(F.array(*findings), lambda f: f.isNotNull())
    # the outer form keeps the optimizer from evaluating all rules a second time to test for none
    found = low.select(key, hits.alias("_hits")).select(key, F.inline_outer("_hits"))
    return found.filter(F.col("rule_id").isNotNull())


def _prose_measures(text: Column) -> dict[str, Column]:
    """What tells running clinical prose from tables and lists."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    words = F.aggregate(
        lines, F.lit(0), lambda acc, line: acc + F.regexp_count(line, F.lit(NOT_SPACE))
    )
    return {
        "n_chars": F.length(text),
        "vocab_hits": F.regexp_count(text, F.lit("(?iU)" + CLINICAL_WORDS)),
        "n_lines": F.size(lines),
        "n_words": words,
        "paddings": F.regexp_count(text, F.lit("   +")),
        "sentence_breaks": F.regexp_count(text, F.lit(r"(?U)[.!?]\s+[A-Z]")),
    }


def _is_prose(m: dict[str, Column]) -> Column:
    per_line = m["n_words"] / F.when(m["n_lines"] > 0, m["n_lines"])
    dense = m["paddings"] / F.greatest(m["n_chars"], F.lit(1)) * 1000 <= MAX_PADDING_PER_1000
    return (
        (m["n_chars"] >= MIN_PROSE_CHARS)
        & (m["vocab_hits"] >= MIN_PROSE_WORDS)
        & F.coalesce(per_line >= MIN_WORDS_PER_LINE, F.lit(True))
        & dense
        & (m["sentence_breaks"] >= MIN_SENTENCE_BREAKS)
    )


def _prose_finding(text: Column, m: Column) -> Column:
    """The finding of a text that reads like a note body: the whole text, described by two numbers."""
    said = F.concat(
        m["n_chars"].cast("string"), F.lit(" characters with "), m["vocab_hits"].cast("string"),
        F.lit(" clinical terms in running sentences"),
    )
    return F.when(
        _is_prose({name: m[name] for name in _prose_measures(text)}),
        F.struct(
            F.lit(PROSE_RULE).alias("rule_id"),
            F.lit("long_clinical_prose").alias("category"),
            F.lit("HIGH").alias("severity"),
            F.lit(1).alias("start"),
            m["n_chars"].alias("length"),
            said.alias("context"),
        ),
    )


def clinical_prose_flag(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether a text reads like the body of a clinical note, with the measures behind it."""
    measures = _prose_measures(F.coalesce(F.col("text"), F.lit("")))
    measured = docs.select(key, *[m.alias(name) for name, m in measures.items()])
    return measured.withColumn("is_prose", _is_prose({name: F.col(name) for name in measures}))


def prose_findings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that read like a note body, as ``phi_scan`` reports them."""
    return phi_scan(docs, rules=(), key=key)


def phi_summary(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings and texts per severity; no row at all means the scan passed."""
    per_text = findings.groupBy("severity", key).agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("severity").agg(
        F.sum("n").alias("n_findings"), F.count(key).alias("n_docs")
    )


def phi_verdict(findings: DataFrame) -> DataFrame:
    """One row: number of findings and whether the scan passed."""
    counted = findings.agg(F.count(F.lit(1)).alias("n_findings"))
    return counted.withColumn("passed", F.col("n_findings") == 0)


def audit_first_finding(
    docs: DataFrame,
    allowlist: dict[str, Collection] | None = None,
    excluded: Collection = (),
    key: str = "doc_id",
    window: int = 30,
) -> DataFrame:
    """The first rule that fires on a text, in the fixed order of categories and patterns.

    ``allowlist`` names, per category, the texts where that category is no finding; ``excluded``
    texts are not looked at. The line of the match and its surroundings are reported.
    """
    text = F.col("text")
    allowed = allowlist or {}
    tries = []
    for category, patterns in AUDIT_GROUPS:
        skipped = F.col(key).isin(list(allowed.get(category, ())))
        for pattern in patterns:
            java = "(?iU)" + pattern
            tries.append(
                F.when(
                    ~skipped & _fires(text, pattern),
                    F.struct(
                        F.lit(category).alias("category"),
                        F.lit(pattern).alias("pattern"),
                        match_start(text, java).alias("start"),
                        F.length(F.regexp_substr(text, F.lit(java))).alias("length"),
                    ),
                )
            )
    looked_at = docs.filter(~F.col(key).isin(list(excluded))) if excluded else docs
    low = computed_once(looked_at.select(key, "text"), _low=caseless(text))
    first = computed_once(low, f=F.coalesce(*tries)).filter("f IS NOT NULL")
    start, length = F.col("f.start"), F.col("f.length")
    before = F.substring(text, F.lit(1), start - 1)
    begin = F.greatest(start - window, F.lit(1))
    around = F.substring(text, begin, start + length + window - begin)
    return first.select(
        key,
        "f.category",
        "f.pattern",
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line_no"),
        F.trim(F.replace(around, F.lit("\n"), F.lit(" "))).alias("context"),
    )
