"""Code expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions.text import SPACE_CHARS

# Fixed values shown in reports for a code without a title.
NO_TITLE = "(no description)"
NOT_IN_DICTIONARY = "(not in d_icd_diagnoses)"


def normalize_code(code: Column) -> Column:
    """Upper-cased code without surrounding white space."""
    return F.upper(F.btrim(code, F.lit(SPACE_CHARS)))


def format_code(code: Column) -> Column:
    """Stored code to display form: a period after the third character of a longer code."""
    dotted = F.concat_ws(".", F.substring(code, 1, 3), F.substring(code, 4, 1000))
    return F.when(F.length(code) > 3, dotted).otherwise(code)


def default_description(title: Column, missing: str = NO_TITLE) -> Column:
    """The title, or a fixed text without one."""
    return F.coalesce(title, F.lit(missing))
