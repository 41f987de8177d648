"""Error categories of the query interface."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; ``code`` is the category."""

    code = "INTERNAL"


class BadArguments(EngineError):
    code = "BAD_ARGS"


class BadRequest(EngineError):
    code = "BAD_REQUEST"


class SchemaMismatch(EngineError):
    code = "DB_SCHEMA"


class DataError(EngineError):
    code = "DB_ERROR"


class InputError(EngineError):
    code = "IO_ERROR"


def category(error: BaseException) -> str:
    """The category of any exception, Spark's included."""
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    if isinstance(error, EngineError):
        return error.code
    if isinstance(error, (ParseException, AnalysisException)):
        return "PATH_NOT_FOUND" in str(error) and InputError.code or BadRequest.code
    if isinstance(error, (ValueError, TypeError, KeyError)):
        return BadArguments.code
    if isinstance(error, OSError):
        return InputError.code
    return DataError.code if isinstance(error, PySparkException) else EngineError.code
