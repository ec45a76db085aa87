"""The error classes of the engine."""


class SchemaError(ValueError):
    """The schema is invalid; nothing can be run."""


class RecordError(ValueError):
    """One record failed; the next ones can go on."""


class FatalError(ValueError):
    """The input can't be read beyond this point."""
