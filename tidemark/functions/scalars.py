"""Scalar expressions: null-safe arithmetic, lossy parsing, labels, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which texts count as true, what looks like a number, and the
# accented letters folded before keywords are compared.
TRUE_TEXTS = ["1", "true", "si", "sí", "yes", "y", "t"]
STRICT_TRUE_TEXTS = ["true", "si", "sí", "verdadero", "1"]
NUMBER_TEXT = r"^-?\$?\s?\d{1,3}([.,]\d{3})*([.,]\d+)?$|^-?\d+([.,]\d+)?$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncy"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null when the quotient has no meaning (ANSI would raise)."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def pct_change(new: str | Column, old: str | Column) -> Column:
    return (safe_div(new, old) - 1) * 100


def parse_number(c: str | Column) -> Column:
    """Text to double under either decimal convention; unreadable is null.

    With both marks present the last one is decimal.  A lone comma is decimal
    only when it is single and not followed by exactly three characters.
    """
    return number_of(number_text(c))


def number_text(c: str | Column) -> Column:
    """The text without currency marks and blanks.

    `replace` scans bytes and returns the same string when nothing matches,
    which beats `translate` and patterns on a hot column.
    """
    t = as_col(c).cast("string")
    for mark in ("$", " ", "\u00a0", "\t", "\n", "\r"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    return t


def number_of(t: Column) -> Column:
    """The double in a text already stripped by `number_text`."""
    comma, dot, nothing = F.lit(","), F.lit("."), F.lit("")
    tail = F.substring_index(t, ",", -1)
    no_commas = F.replace(t, comma, nothing)
    commas = F.length(t) - F.length(no_commas)
    plain = (
        F.when(~t.contains(","), t)
        .when(
            t.contains("."),
            F.when(tail.contains("."), no_commas).otherwise(F.replace(F.replace(t, dot, nothing), comma, dot)),
        )
        .when((commas == 1) & (F.length(tail) != 3), F.replace(t, comma, dot))
        .otherwise(no_commas)
    )
    return F.regexp_extract(plain, PLAIN_NUMBER, 0).try_cast("double")


def to_number(c: str | Column, dtype: str) -> Column:
    """Numeric view of a column of type `dtype`; text goes through a lossy cast."""
    return as_col(c).try_cast("double") if dtype == "string" else as_col(c).cast("double")


def is_true(c: str | Column) -> Column:
    """Everything outside the truthy texts, nulls included, is false."""
    return F.coalesce(F.lower(F.trim(as_col(c).cast("string"))).isin(TRUE_TEXTS), F.lit(False))


def date_from_key(c: str | Column) -> Column:
    """Integer yyyymmdd or date text to a date; out of range or bad is null."""
    t = F.trim(as_col(c).cast("string"))
    key = t.try_cast("int")
    in_range = key.between(19000101, 29991231)
    packed = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    return F.when(t.rlike(r"^\d{8}$"), F.when(in_range, packed.try_cast("date"))).when(
        ~t.rlike(r"^\d+$"), t.try_cast("date")
    )


def date_key(c: str | Column) -> Column:
    """Date to integer yyyymmdd, 0 where there is no date."""
    d = as_col(c)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(0)).cast("int")


def normalise_value(c: str | Column, kind: str, day_first: bool = True) -> Column:
    """One text cell in canonical form for its declared kind, blank to null.

    Numbers take a decimal point, day/month/year dates become ISO with a
    two-digit-year pivot at 70, booleans follow the strict truthy list.
    """
    raw = as_col(c).cast("string")
    t = F.trim(raw)
    filled = F.length(t) > 0
    if kind == "string":
        return F.coalesce(raw, F.lit(""))
    if kind in ("integer", "number"):
        n = F.regexp_replace(F.regexp_replace(t, " ", ""), ",", ".")
        return F.when(filled & n.rlike(r"^-?\d+(\.\d+)?$"), n)
    if kind == "boolean":
        return F.when(filled, F.lower(t).isin(STRICT_TRUE_TEXTS).cast("string"))
    if kind != "date":
        raise ValueError(f"unknown kind {kind!r}")
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}:\d{2}(?::\d{2})?))?$"
    dmy = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})(?:[ T](\d{1,2}:\d{2}(?::\d{2})?))?$"
    year = F.regexp_extract(t, dmy, 3)
    full_year = F.when(
        F.length(year) == 2,
        F.concat(F.when(year.try_cast("int") < 70, F.lit("20")).otherwise(F.lit("19")), year),
    ).otherwise(year)
    first, second = F.regexp_extract(t, dmy, 1), F.regexp_extract(t, dmy, 2)
    day, month = (first, second) if day_first else (second, first)

    def joined(y, m, d, clock):
        text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.when(F.length(clock) > 0, F.concat(text, F.lit("T"), clock)).otherwise(text)

    return F.when(
        t.rlike(iso),
        joined(*(F.regexp_extract(t, iso, i) for i in (1, 2, 3)), F.regexp_extract(t, iso, 4)),
    ).when(t.rlike(dmy), joined(full_year, month, day, F.regexp_extract(t, dmy, 4)))


def fold_accents(c: str | Column) -> Column:
    return F.translate(F.lower(as_col(c)), ACCENTED, PLAIN)


def format_number(c: str | Column, mask: str = "#,0") -> Column:
    """`.` thousands and `,` decimals; a % mask scales by 100; null is a dash."""
    percent = mask.endswith("%")
    tail = mask.split(".")[1] if "." in mask else ""
    digits = len(tail.rstrip(" %"))
    value = as_col(c).cast("double") * (100 if percent else 1)
    text = F.translate(F.format_number(value, digits), ",.", ".,")
    if percent:
        text = F.concat(text, F.lit(" %"))
    return F.coalesce(text, F.lit("—"))
