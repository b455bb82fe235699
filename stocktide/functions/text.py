"""Cleaning of text cells: every value arrives as a string."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that decide what a row or a name means.
SERVICE_WORDS = ("transport", "livrare", "montaj", "servicii")
ACCOUNTING_MARKERS = ("clasa discount", "subclasa discount", "puncte m&you", "puncte utilizate")
ACCOUNTING_CODES = ("PUNCTE", "LMPM")
YES_WORDS = ("DA", "YES", "Y", "TRUE", "1")
NO_WORDS = ("NU", "NO", "N", "FALSE", "0")
MONTH_NAMES = (
    "IANUARIE", "FEBRUARIE", "MARTIE", "APRILIE", "MAI", "IUNIE",
    "IULIE", "AUGUST", "SEPTEMBRIE", "OCTOMBRIE", "NOIEMBRIE", "DECEMBRIE",
)
# Accented letters and what is left without the mark.
ACCENTED = "ÀÁÂÃÄÅĀĂĄÇĆĈĊČĎÈÉÊËĒĔĖĘĚĜĞĠĢĤÌÍÎÏĨĪĬĮİĴĶĹĻĽÑŃŅŇÒÓÔÕÖŌŎŐŔŖŘŚŜŞŠȘŢŤȚÙÚÛÜŨŪŬŮŰŲŴÝŶŸŹŻŽ"
UNACCENTED = "AAAAAAAAACCCCCDEEEEEEEEEGGGGHIIIIIIIIIJKLLLNNNNOOOOOOOORRRSSSSSTTTUUUUUUUUUUWYYYZZZ"

_DIMENSION = r"(?i)(\d+(?:[.,]\d+)?(?:\s*x\s*\d+(?:[.,]\d+)?){1,2})\s*(?:cm)?"


# What outer trimming can remove, and the line ends that its pattern looks behind.
_OUTER = (" ", "\t", "\n", "\x0b", "\f", "\r", '"')
_LINE_ENDS = ("\x85", "\u2028", "\u2029")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once.

    Written out, every use of ``c`` in ``f`` is a copy of its whole expression;
    rules on top of rules and a pushed-down filter then multiply the copies.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def clean_text(c: Column) -> Column:
    """Drop BOM, outer space and outer quotes; NULL becomes ''.

    The pattern is tried at every character, so it is only run on texts whose
    first or last character it can remove.
    """
    c = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\ufeff"), F.lit(""))
    outer = lambda t: F.left(t, F.lit(1)).isin(*_OUTER) | F.right(t, F.lit(1)).isin(*_OUTER, *_LINE_ENDS)
    return once(c, lambda t: F.when(outer(t), F.regexp_replace(t, r'^\s*"*\s*|\s*"*\s*$', "")).otherwise(t))


def null_if_empty(c: Column) -> Column:
    """Cleaned text, NULL when it is empty or '#null'."""
    bare = lambda t: F.when(t.startswith("#"), F.regexp_replace(t, "(?i)^#null$", "")).otherwise(t)
    return once(once(clean_text(c), bare), lambda t: F.when(t != "", t))


def parse_decimal_comma(c: Column) -> Column:
    """'1,5' -> 1.5; blank, '#null' and text that is no number -> NULL."""
    return F.replace(null_if_empty(c), F.lit(","), F.lit(".")).try_cast("double")


def discount_fraction(c: Column) -> Column:
    """Absolute discount when it is a finite fraction of at most 1."""
    return F.when(~F.isnan(c) & (F.abs(c) <= 1.0), F.abs(c))


def parse_date_multi(c: Column, formats: tuple[str, ...] = ("d.M.yyyy", "yyyy-M-d")) -> Column:
    """First format that gives a valid date.

    The shape is looked at before parsing: a failed parse raises and catches
    an exception per row, which costs far more than the pattern.
    """
    tries = lambda t: F.coalesce(*[F.when(t.rlike(f"^{_shape(f)}$"), F.try_to_date(t, f)) for f in formats])
    return once(null_if_empty(c), tries)


def _shape(fmt: str) -> str:
    """Pattern of the texts a date format can read."""
    parts = {"yyyy": r"\d{4}", "MM": r"\d{1,2}", "dd": r"\d{1,2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "".join(parts.get(p, re.escape(p)) for p in re.findall(r"yyyy|MM|dd|M|d|[^yMd]", fmt))


def yes_no_flag(c: Column) -> Column:
    return once(F.upper(clean_text(c)), lambda u: F.when(u.isin(*YES_WORDS), F.lit(1)).when(u.isin(*NO_WORDS), F.lit(0)).cast("int"))


def slug(c: Column, default: str = "unknown_store") -> Column:
    s = F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return once(s, lambda t: F.when(t == "", F.lit(default)).otherwise(t))


def strip_accents(c: Column) -> Column:
    """Upper-case key without accents and with single spaces.

    ``translate`` covers the precomposed Latin letters; marks that arrive as
    separate combining characters are removed by the pattern.
    """
    u = F.regexp_replace(F.upper(c), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.translate(u, ACCENTED, UNACCENTED), r"\s+", " "))


def non_product_flag(category: Column, klass: Column, subclass: Column, name: Column, sku: Column) -> Column:
    """1 for services and accounting lines that are not product demand."""
    text = F.lower(F.concat_ws(" ", *[clean_text(c) for c in (category, klass, subclass, name, sku)]))
    words = "|".join(SERVICE_WORDS + ACCOUNTING_MARKERS)
    accounting = once(F.upper(clean_text(sku)), lambda code: code.startswith("DISCOUNT") | code.isin(*ACCOUNTING_CODES))
    return (text.rlike(words) | accounting).cast("int")


def extract_dimensions(name: Column) -> Column:
    """Every AxB or AxBxC token of a product name, joined by '|'; NULL if none."""
    found = F.regexp_extract_all(name, F.lit(_DIMENSION), F.lit(1))
    tidy = F.transform(found, lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))
    return once(F.array_join(tidy, "|"), lambda t: F.when(t != "", t))


def number_text(c: Column) -> Column:
    """Text of the whole value of a measure, for keys: different values never share one."""
    return c.cast("string")


def transaction_key(store, invoice, order, sku, sale_date, value, quantity, name) -> Column:
    """SHA-256 of the line identity; missing parts count as empty text."""
    parts = [store, invoice, order, sku, sale_date.cast("string"), number_text(value), number_text(quantity), name]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), name).cast("int")


def month_label_to_date(c: Column) -> Column:
    """'<MONTH> <YEAR>...' label or header -> first day of that month."""
    u = strip_accents(c)
    m = month_number(F.regexp_extract(u, r"([A-Z]+)\s+(20\d{2})", 1))
    y = F.regexp_extract(u, r"([A-Z]+)\s+(20\d{2})", 2).try_cast("int")
    return F.when(m > 0, F.make_date(y, m, F.lit(1)))
