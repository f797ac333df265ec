"""String and CSV expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_nonempty(s: Column, delimiter: str) -> Column:
    """Tokens between literal delimiters, without the empty ones."""
    return F.filter(F.split(s, re.escape(delimiter), -1), lambda t: t != "")


def balanced_quotes(line: Column) -> Column:
    """Whether a CSV line has an even number of double quotes."""
    return F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 0


def csv_fields(line: Column, delimiter: str = ",") -> Column:
    """Fields of a CSV line: delimiters in quotes don't split; one pair of outer quotes is stripped, inner ones stay."""
    d = re.escape(delimiter)
    fields = F.split(line, f'{d}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    quoted = lambda f: (F.length(f) >= 2) & f.startswith('"') & f.endswith('"')
    return F.transform(fields, lambda f: F.when(quoted(f), f.substr(F.lit(2), F.length(f) - 2)).otherwise(f))


def extension(path: Column) -> Column:
    """The extension with its dot, in lower case, or ''."""
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))


def safe_name(s: Column) -> Column:
    """Characters that file names can't have, as underscores."""
    return F.translate(s, ":/\\", "___")


def padded(n: Column, width: int) -> Column:
    """Zero-padded whole number; a longer one stays whole."""
    t = n.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def fixed_decimals(x: Column, digits: int) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{digits}f", x)


def parsed(s: Column, kind: str) -> Column:
    """A value of a type ('int', 'double', ...) from text without blanks around it; null where it is none."""
    return F.trim(s).try_cast(kind)


def shown(*parts: Column) -> Column:
    """Values as (a, b, ...)."""
    return F.concat(F.lit("("), F.concat_ws(", ", *(p.cast("string") for p in parts)), F.lit(")"))
