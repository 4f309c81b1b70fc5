"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. The patterns need no backtracking over their repeats (possessive), and a search does not start again inside a
run that has already failed, so a very long text costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.spans import letters_of, nearby, with_matches

#: Kinds in order, their patterns, and how likely a confirmed span is without context.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|contact|write|mail)\b",
    "ip": r"(?i)\b(ip|host|address|server|from)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment|cvv)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|dial)\b",
    "iban": r"(?i)\b(iban|bank|account|transfer)\b",
    "ssn": r"(?i)\b(ssn|social|security|taxpayer)\b",
}
AGAINST = r"(?i)\b(version|order|invoice|isbn|sku|example|sample|test)\b"
CONTEXT_REACH = 40
CONTEXT_GAIN = 0.3
AGAINST_LOSS = 0.2
LEAST_SCORE = 0.5


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn checksum of a text of digits: every second digit from the right is doubled, its digits summed."""

    def weighed(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        return F.when(place % 2 == 0, value).otherwise(value * 2 - F.when(value > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(letters_of(F.reverse(digits)), weighed), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def passes_mod97(account: Column) -> Column:
    """Check digits of an account number: first four characters last, letters as 10 to 35, remainder 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(letters_of(turned), F.lit(0), step) == 1


def confirmed(kind: str, text: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    if kind == "ip":
        whole = F.transform(F.split(text, r"\."), lambda part: F.ltrim(part, F.lit("0")))  # without leading zeros
        return F.forall(whole, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))
    if kind == "card":
        n = F.length(digits_of(text))
        return F.when(n.between(12, 19), passes_luhn(digits_of(text))).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(text)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(text, " ", "")).between(15, 34) & passes_mod97(text)
    return F.lit(True)


def guard(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "iban":
        return text.rlike("[A-Z]{2}[0-9]{2}")
    return text.rlike("[0-9]")


def _scored(text: Column, kind: str) -> Callable[[Column], Column]:
    """A match as a span with its score: likely by kind, more so with the kind's words around it, less so with others."""

    def span(match: Column) -> Column:
        end = match["start"] + F.length(match["text"])
        around = F.concat_ws(" ", *nearby(text, match["start"], end, CONTEXT_REACH))
        gain = F.when(around.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        loss = F.when(around.rlike(AGAINST), AGAINST_LOSS).otherwise(0.0)
        return F.struct(
            match["start"].cast("long").alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            end.cast("long").alias("end"),
            F.lit(kind).alias("kind"),
            match["text"].alias("text"),
            F.greatest(F.least(F.lit(PRIOR[kind]) + gain - loss, F.lit(1.0)), F.lit(0.0)).alias("score"),
        )

    return span


def find_personal_data(documents: DataFrame, text_col: str = "text", into: str = "personal_data") -> DataFrame:
    """``documents`` with ``into``: array<struct<start, rank, end, kind, text, score>> by start, then kind as listed in ``KINDS``.

    Spans of the base kinds stay whatever their score; of the other kinds only those of ``LEAST_SCORE`` or more. NULL and empty texts
    have none. One row per input row, repeated rows included; an empty table gives an empty result. Other columns are kept, but for one
    called like ``into``, which is replaced: pass another name to keep it.
    """
    text = "__text"
    df = documents.withColumn(text, F.coalesce(documents[text_col].cast("string"), F.lit("")))
    lists = []
    for kind in KINDS:
        column = f"__{kind}"
        df = with_matches(df, text, column, PATTERNS[kind], guard(kind, F.col(text)), lambda match, kind=kind: confirmed(kind, match))

        spans = F.transform(F.col(column), _scored(F.col(text), kind))
        lists.append(spans if kind in BASE else F.filter(spans, lambda span: span["score"] >= LEAST_SCORE))
    return df.withColumn(into, F.array_sort(F.concat(*lists))).drop(text, *(f"__{kind}" for kind in KINDS))


def digest(found: DataFrame, id_col: str = "doc_id", spans_col: str = "personal_data") -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text; one row per input row."""
    spans = F.col(spans_col)

    def said(some: Column) -> Column:
        return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter(spans, lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(F.col(id_col), *counts, F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"))
