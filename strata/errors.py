"""Error kinds. "Already applied" and "conflict" are results, not errors."""


class InvalidArgument(ValueError):
    """A malformed request: empty name, missing keys, SQL that does not parse."""


class NotFound(ValueError):
    """A table, branch or version that was named but does not exist."""


class FailedPrecondition(ValueError):
    """A guard said no: stale version, truncated input, failed quality test."""
