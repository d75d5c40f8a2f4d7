"""Text normalisation, hashing and token functions, as Column expressions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points that count as white space and as word characters.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
SEPARATOR = "\x1e"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C: the one text function without a built-in.  ASCII texts are not sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


NORMALIZERS: dict[str, Callable[[Column], Column]] = {"nfc": nfc, "collapse_whitespace": collapse_whitespace}


def normalize(names: Iterable[str], text: Column) -> Column:
    """The named normalizers in order; a name that is not registered raises KeyError."""
    return functools.reduce(lambda c, name: NORMALIZERS[name](c), names, text)


def word_count(text: Column) -> Column:
    """Words of a text whose white space is collapsed; an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def short_hash(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by a record separator."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.left(F.sha2(F.concat_ws(SEPARATOR, *columns) if len(columns) > 1 else columns[0], 256), F.lit(16))


def canonical_json(value: Column, fields: Iterable[str]) -> Column:
    """Compact JSON of a struct with its fields in name order: a key for equality, not for display."""
    return F.to_json(F.struct(*[value[f].alias(f) for f in sorted(fields)]))


def tokens(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def percent(count: Column, n: Column) -> Column:
    """100 * count / n, and 0 where n is 0."""
    return F.when(n == 0, 0.0).otherwise(100.0 * count / F.nullif(n, F.lit(0)))


def p_text(p: Column) -> Column:
    """A p-value for display: '<0.0001', or four decimals."""
    return F.when(p < 0.0001, "<0.0001").otherwise(F.format_string("%.4f", p))


def signed_points(delta: Column) -> Column:
    """A difference of shares in percentage points, signed, two decimals."""
    return F.format_string("%+.2f", 100.0 * delta)
