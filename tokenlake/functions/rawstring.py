"""Raw string literals `R"d(...)d"`, scanned with built-in column functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest delimiter, and the punctuation that delimiters may hold besides letters and digits.
MOST = 16
PUNCTUATION = "!\"#%&'*+,-./:;<=>?[]^_{|}~"
_CLASS = "".join("\\" + c if not c.isalnum() else c for c in string.ascii_letters + string.digits + PUNCTUATION)

# What errors say.
NOT_RAW, BAD_DELIMITER, UNTERMINATED = "Not a raw string literal", "Invalid raw string delimiter", "Unterminated raw string literal"


def scan_raw_string(text: Column, offset: Column | int = 0) -> Column:
    """struct(length, error) of the literal that begins at this offset (in the column's own units) of a text; one of the two is null."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    rest = F.substring(text, offset + 1, F.length(text))
    body = F.substring(rest, 3, F.length(rest))
    open_at = F.locate("(", body)
    delimiter = F.when(open_at > 0, F.substring(body, F.lit(1), open_at - 1)).otherwise(body)
    closing = F.concat(F.lit(")"), delimiter, F.lit('"'))
    proper = delimiter.rlike(f"\\A[{_CLASS}]{{0,{MOST}}}\\z")
    close_at = F.position(closing, F.substring(body, open_at + 1, F.length(body)))
    length = (2 + open_at + close_at - 1 + F.length(closing)).cast("long")
    error = (
        F.when(text.isNull() | ~F.startswith(rest, F.lit('R"')), NOT_RAW)
        .when(~proper, BAD_DELIMITER)
        .when((open_at == 0) | (close_at == 0), UNTERMINATED)
    )
    return F.struct(F.when(error.isNull(), length).alias("length"), error.alias("error"))
