"""The engine's errors."""


class TidemarkError(Exception):
    """Base of all; `sqlstate` is what a client is told."""

    sqlstate = "42000"


class ConfigError(TidemarkError):
    sqlstate = "F0000"


class SourceError(TidemarkError):
    sqlstate = "08000"


class UnsupportedTypeError(TidemarkError):
    sqlstate = "0A000"


class NotReadOnlyError(TidemarkError):
    sqlstate = "25006"


class ResultTooLargeError(TidemarkError):
    sqlstate = "54000"
