"""Text expressions: codes, first-match edits, numbers in text, labels."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_code(code: Column | str, pad: str = "") -> Column:
    """Upper-case a code and put the dot after its third character.

    A trailing ``X`` stands for "no fourth character" and becomes ``.0``.
    Three-character codes end in a bare dot, which sorts below every ``.0``;
    ``pad="0"`` completes them instead.
    """
    code = F.upper(_col(code))
    tail = F.substr(code, F.lit(4))
    if pad:
        tail = F.when(tail == "", F.lit(pad)).otherwise(tail)
    return F.when(code.endswith("X"), F.regexp_replace(code, "X$", ".0")).otherwise(
        F.concat(F.substring(code, 1, 3), F.lit("."), tail)
    )


def replace_first(text: Column | str, pattern: str, replacement: str = "") -> Column:
    """Replace only the leftmost match (``regexp_replace`` alone replaces all).

    ``pattern`` must not use numbered groups.
    """
    return F.regexp_replace(_col(text), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def remove_first(text: Column | str, pattern: str) -> Column:
    return replace_first(text, pattern)


def remove_all(text: Column | str, pattern: str) -> Column:
    return F.regexp_replace(_col(text), pattern, "")


def strip_digits_and_marks(text: Column | str) -> Column:
    """Drop digits and ASCII punctuation, keeping letters and spaces."""
    return remove_all(text, r"[0-9\p{Punct}]")


def title_case(text: Column | str, sep: str = "-") -> Column:
    """First letter of every word upper, words split at spaces and at ``sep``."""
    parts = F.transform(F.split(_col(text), re.escape(sep)), F.initcap)
    return F.array_join(parts, sep)


def parse_number(text: Column | str, grouping: str = ",", decimal: str = ".") -> Column:
    """First number inside a text as double; NULL when there is none."""
    g, d = re.escape(grouping), re.escape(decimal)
    found = F.regexp_extract(_col(text).cast("string"), f"-?[0-9][0-9{g}]*(?:{d}[0-9]+)?", 0)
    plain = F.regexp_replace(found, g, "")
    if decimal != ".":
        plain = F.regexp_replace(plain, d, ".")
    return plain.try_cast("double")


def percent_text(share: Column | str, digits: int = 1) -> Column:
    """Share as text such as ``12.3%``; ties go to the even digit."""
    return F.format_string(f"%.{digits}f%%", F.bround(_col(share) * 100, digits))


def number_text(number: Column | str, digits: int = 0, decimal: str = ",", grouping: str = ".") -> Column:
    """Number as text with the decimal and thousands marks of a language."""
    return F.translate(F.format_number(_col(number), digits), ".,", decimal + grouping)


def united(cols: list[str], sep: str = "_", null_text: str = "NA") -> Column:
    """Values joined into one key; NULL is written out, not skipped."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in cols])


def snake_names(names: list[str]) -> list[str]:
    """Column names in ASCII snake case, made unique with ``_2``, ``_3``, ..."""
    out, seen = [], {}
    for name in names:
        text = name.replace("%", "_percent_").replace("#", "_number_")
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower() or "x"
        if text[0].isdigit():
            text = "x" + text
        seen[text] = seen.get(text, 0) + 1
        out.append(text if seen[text] == 1 else f"{text}_{seen[text]}")
    return out
