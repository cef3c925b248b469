"""The dialect's column types and the rules their values obey."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import AnalysisError

INT32 = (-(2**31), 2**31 - 1)
#: Bytes a string type holds at most. `text` has no index and cannot be a key.
STRING_BYTES = {"char8": 8, "char16": 16, "char32": 32, "text": 255}
TYPES = ("int", *STRING_BYTES, "bool")
_INT = re.compile(r"[+-]?[0-9]+")


def spark_type(kind: str) -> T.DataType:
    if kind == "int":
        return T.IntegerType()
    return T.BooleanType() if kind == "bool" else T.StringType()


def kind_of(data_type: T.DataType) -> str:
    """The family of a Spark type, for tables registered from outside."""
    if isinstance(data_type, T.IntegerType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def family(kind: str) -> str:
    return "number" if kind in ("int", "number") else "text" if kind in STRING_BYTES else kind


def literal_value(text: str, kind: str, column: str, *, store: bool = False):
    """A literal's Python value for comparison with (or, with ``store``, insertion into) a column."""
    if kind == "int":
        if not _INT.fullmatch(text):
            raise AnalysisError(f"VALIDATOR ERROR: column {column} needs an integer, not {text!r}")
        value = int(text)
        if not INT32[0] <= value <= INT32[1]:
            raise AnalysisError(f"VALIDATOR ERROR: {text} is out of the range of column {column}")
        return value
    if kind == "number":
        try:
            return int(text) if _INT.fullmatch(text) else float(text)
        except ValueError:
            raise AnalysisError(f"VALIDATOR ERROR: column {column} needs a number, not {text!r}") from None
    if kind == "bool":
        if text not in ("true", "false"):
            raise AnalysisError(f"VALIDATOR ERROR: column {column} needs a boolean, not {text!r}")
        return text == "true"
    if kind == "other":
        raise AnalysisError(f"VALIDATOR ERROR: column {column} cannot be compared with a literal")
    if store:
        size = len(text.encode())
        if kind in STRING_BYTES and size > STRING_BYTES[kind]:
            raise AnalysisError(f"VALIDATOR ERROR: {text!r} is longer than {kind} of column {column}")
        if kind != "text" and not size:
            raise AnalysisError(f"VALIDATOR ERROR: column {column} needs a value that is not empty")
    return text


def parsed(raw: Column, kind: str) -> Column:
    """A delivered string as a value of the type; null if it is none."""
    if kind == "int":
        return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("int"))
    if kind == "bool":
        return F.when(raw == "true", F.lit(True)).when(raw == "false", F.lit(False))
    return F.when(F.octet_length(raw) <= STRING_BYTES[kind], raw)
