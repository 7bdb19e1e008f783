"""Column functions on text that Spark and DuckDB agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space at the ends of a text: space, tab, carriage return, line feed, no-break space.
BLANKS = " \t\r\n\N{NO-BREAK SPACE}"
#: The same as a regular-expression class.
BLANK_CLASS = f"[{BLANKS}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends; null stays null."""
    return F.btrim(_col(c), F.lit(BLANKS))


def normal_id(c: Column | str) -> Column:
    """An id as references compare it: trimmed, lower case, null where empty."""
    return F.nullif(F.lower(strip(_col(c))), F.lit(""))


def render_document(title: Column | str, body: Column | str) -> Column:
    """Title and body joined by a space, or the body alone; never null."""
    t, b = strip(F.coalesce(_col(title), F.lit(""))), strip(F.coalesce(_col(body), F.lit("")))
    return strip(F.when(t != "", F.concat_ws(" ", t, b)).otherwise(b))


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``term``, a row per token of :func:`tokens`; split and filter stay in generated code."""
    return df.select(key, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("term")).filter(F.col("term") != "")


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order, with repeats."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
