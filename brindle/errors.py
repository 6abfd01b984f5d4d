"""Error kinds of the engine, and the translation of Spark's own."""

from __future__ import annotations

import functools

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ArithmeticException, ParseException, PySparkException


class EngineError(Exception):
    """Base of every error the engine raises."""


class SqlSyntaxError(EngineError):
    """The SQL text does not parse."""


class InvalidOperation(EngineError):
    """The query is well formed but has no meaning (types, names, shapes)."""


class InvalidData(EngineError):
    """A value can't be computed: overflow, division by zero, a bad cast."""


class SourceError(EngineError):
    """A file or table can't be read."""


#: Spark's names for records and values that can't be read as the schema says.
MALFORMED = ("MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD", "CAST_INVALID_INPUT")


def translate(error: Exception) -> EngineError:
    said = str(error).split("\n")[0]
    if any(name in str(error) for name in MALFORMED):
        return InvalidData(said)
    if isinstance(error, ParseException):
        return SqlSyntaxError(said)
    if isinstance(error, AnalysisException):
        return SourceError(said) if "PATH_NOT_FOUND" in said else InvalidOperation(said)
    if isinstance(error, ArithmeticException):
        return InvalidData(said)
    return EngineError(said)


def translated(method):
    """Let a method raise the engine's errors instead of Spark's."""

    @functools.wraps(method)
    def run(*args, **named):
        try:
            return method(*args, **named)
        except (PySparkException, Py4JJavaError) as error:  # a task's failure can come as the latter
            raise translate(error) from error

    return run
