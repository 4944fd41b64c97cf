"""Errors of the parsers. Queries keep them in an ``error`` column; ``failfast`` raises instead."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MediaError(ValueError):
    """A file that can't be read, with a kind such as ``missing_marker`` and what it was about."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def attempt(parse: Callable[..., Any], *args: Any) -> tuple[Any, str | None]:
    """(result, None) or (None, error text); data that end too early are ``unexpected_end``."""
    if args and args[0] is None:
        return None, None
    try:
        return parse(*args), None
    except MediaError as e:
        return None, str(e)
    except (IndexError, EOFError, struct.error):
        return None, "unexpected_end"
    except (ValueError, LookupError, ArithmeticError, zlib.error) as e:  # what broken data cause; bugs of other kinds come through
        return None, f"invalid_data: {type(e).__name__}"


def failfast(df: DataFrame, error: str = "error") -> DataFrame:
    """Raise at the first row with an error; other rows pass without the error column."""
    return df.where(F.when(F.col(error).isNotNull(), F.raise_error(F.col(error)).cast("boolean")).otherwise(F.lit(True))).drop(error)
