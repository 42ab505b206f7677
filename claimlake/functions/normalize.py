"""Typed normalizers and comparators. Each builder maps columns to columns; nothing runs row by row in Python."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bind, collapse, strip

#: Aliases of property types, currency symbols, length of the narrative prefix that is compared.
PROPERTY_ALIASES = {"res": "residential", "residential property": "residential", "comm": "commercial", "commercial property": "commercial", "ind": "industrial"}
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₹": "INR"}
PREFIX = 120


def string(c: Column) -> Column:
    return strip(c)


def narrative(c: Column) -> Column:
    return collapse(c)


#: Date shapes, which exclude each other: what the text must look like, and how it is read, in order of preference. Fixed values.
DATE_SHAPES = [
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", ["yyyy-M-d"]),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\z", ["d.M.yyyy"]),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", ["d/M/yyyy", "M/d/yyyy"]),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z", ["d-M-yyyy"]),
    (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}\z", ["MMMM d, yyyy", "MMM d, yyyy"]),
    (r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}\z", ["d MMMM yyyy", "d MMM yyyy"]),
]
COMPACT = r"^([0-9]{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12][0-9]|0[1-9]|[1-9])\z"


def as_date(c: Column) -> Column:
    """The date that a text names, or null. Slash dates are day first unless only month first is valid."""

    def read(flat: Column) -> Column:
        parts = F.concat_ws("-", *[F.regexp_extract(flat, COMPACT, i) for i in (1, 2, 3)])
        out = F
        for shape, forms in DATE_SHAPES:
            out = out.when(flat.rlike(shape), F.coalesce(*[F.try_to_timestamp(flat, F.lit(form)) for form in forms]))
        return out.when(flat.rlike(COMPACT), F.try_to_timestamp(parts, F.lit("yyyy-M-d")))

    return bind(collapse(c), read).cast("date")


def date(c: Column) -> Column:
    return F.coalesce(F.date_format(as_date(c), "yyyy-MM-dd"), strip(c))


#: Amounts of money with their code or symbol: fixed values.
_AMOUNT = rf"(\d[\d,.'\s\x1c-\x1f]*)"
_CODE_FIRST = rf"(?U)(?:([A-Z]{{3}})|([€$£¥₹])){SPACE}*{_AMOUNT}"
_AMOUNT_FIRST = rf"(?U){_AMOUNT}{SPACE}*([A-Z]{{3}})"


def money(c: Column, trim_amount: bool = False) -> Column:
    """struct(code, amount): amount a string of digits of any length; null if the text names no amount of money.

    As in the claims' source system, cents are dropped only at the very end of the captured amount, which may end in
    white space; ``trim_amount`` drops them there too.
    """
    s = strip(c)
    front, back = s.rlike(_CODE_FIRST), s.rlike(_AMOUNT_FIRST)
    symbols = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    code, symbol = F.regexp_extract(s, _CODE_FIRST, 1), F.regexp_extract(s, _CODE_FIRST, 2)
    code = F.when(front, F.when(code != "", code).otherwise(F.try_element_at(symbols, symbol))).otherwise(F.regexp_extract(s, _AMOUNT_FIRST, 2))
    amount = F.when(front, F.regexp_extract(s, _CODE_FIRST, 3)).otherwise(F.regexp_extract(s, _AMOUNT_FIRST, 1))
    amount = strip(amount) if trim_amount else amount
    digits = F.regexp_replace(F.regexp_replace(amount, r"(?U)[.,]\d{1,2}$", ""), r"(?U)[^\d]", "")
    return F.when((front | back) & (digits != ""), F.struct(code.alias("code"), F.regexp_replace(digits, r"^0+(?=.)", "").alias("amount")))


def currency(c: Column, trim_amount: bool = False) -> Column:
    m = money(c, trim_amount)
    return F.when(m.isNotNull(), F.concat_ws(" ", m["code"], m["amount"])).otherwise(strip(c))


def enum(c: Column, aliases: Mapping[str, str] = PROPERTY_ALIASES) -> Column:
    s = F.lower(strip(c))
    if not aliases:
        return s
    known = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.strip().lower(), v)])
    return F.coalesce(F.try_element_at(known, s), s)


NORMALIZERS: dict[str, Callable[[Column], Column]] = {"string": string, "narrative": narrative, "date": date, "currency": currency, "enum": enum}


def register(kind: str, builder: Callable[[Column], Column]) -> None:
    """Add a kind of field; its builder maps a column of raw text to one of canonical text."""
    NORMALIZERS[kind] = builder


def normalize(kind: Column, c: Column) -> Column:
    """Normalize by the kind in a column; an unknown or null kind strips."""
    out = strip(c)
    for name, builder in NORMALIZERS.items():
        out = F.when(kind == name, builder(c)).otherwise(out)
    return out


def merge_key(kind: Column, c: Column) -> Column:
    return F.coalesce(F.lower(normalize(kind, c)), F.lit(""))


def same(kind: str, a: Column, b: Column, prefix: int = PREFIX) -> Column:
    """Whether two values of a kind are equal; null equals null alone."""
    x, y = (NORMALIZERS[kind](v) for v in (a, b))
    if kind == "narrative":
        x, y = F.substring(x, 1, prefix), F.substring(y, 1, prefix)
    if kind in ("string", "narrative"):
        x, y = F.lower(x), F.lower(y)
    return x.eqNullSafe(y)
