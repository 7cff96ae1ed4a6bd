"""Typed errors raised by plan-time and gate checks."""


class CohortError(Exception):
    """Base class of every error this package raises on purpose."""


class SourceError(CohortError):
    """A raw input is missing or cannot be read."""


class StageError(CohortError):
    """A stage was started before the stage it reads from."""


class LabelError(CohortError):
    """Label building got an input it cannot turn into a target."""


class SplitError(CohortError):
    """Split fractions or split membership are invalid."""


class MetricError(CohortError, ValueError):
    """A metric was asked for outside the range where it is defined."""
