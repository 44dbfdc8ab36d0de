"""Typed errors. Messages carry counts and positions, never row values."""


class TidegateError(Exception):
    """Anything this engine refuses."""


class DatasetError(TidegateError):
    """A dataset violates a constraint."""


class PointInTimeError(DatasetError):
    """Information was not available when a decision was made."""


class GovernanceError(DatasetError):
    """Feature lineage does not meet the policy."""


class SourceError(TidegateError):
    """An input cannot be read as declared."""


class LimitError(SourceError):
    """An input exceeds a resource limit."""


class SplitError(TidegateError):
    """A split cannot be planned."""


class InvalidFoldError(SplitError):
    """A planned fold misses its minimums."""


class EvaluationError(TidegateError):
    """Fitting or scoring failed."""


class HoldoutError(TidegateError):
    """The holdout is reused or its boundary is crossed."""


class LedgerError(TidegateError):
    """A forward-ledger rule is violated."""


class RequestError(TidegateError):
    """A request has unknown keys or values out of range."""


class SinkError(TidegateError):
    """An output is there already or cannot be written."""


class RunTimeout(TidegateError):
    """A run took longer than it may."""
