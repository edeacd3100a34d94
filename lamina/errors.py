"""Error classes and the exit codes they stand for."""

from __future__ import annotations


class LaminaError(Exception):
    """Any failure of a run; exit code 1 unless a subclass says otherwise."""

    exit_code = 1


class MalformedInputError(LaminaError):
    pass


class ValidationError(LaminaError):
    pass


class UsageError(LaminaError):
    exit_code = 2


class OutputExistsError(LaminaError):
    exit_code = 3


class DigestMismatchError(LaminaError):
    exit_code = 4
