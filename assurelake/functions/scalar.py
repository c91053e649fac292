"""Scalar helpers that the operators share. All are built-in expressions, none a UDF."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that count as paid and as settled (they differ: SUCCESSFUL is paid only)
PAID = ("PAID", "SUCCESS", "SUCCESSFUL", "COMPLETED")
SETTLED = ("SETTLED", "SUCCESS", "COMPLETED")
VOID = ("CANCELLED", "VOID")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def total(c: Column) -> Column:
    """The sum of money amounts, added as cents: its buffer is a long, a third of a decimal's in a shuffle."""
    return (F.sum((money(c) * 100).cast("long")) * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def zero(c: Column) -> Column:
    """Null as a money zero."""
    return F.coalesce(c, F.lit(0).cast("decimal(18,2)"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def clamp(n: int, most: int) -> int:
    """Limits of list queries: 1 at least, `most` at most."""
    return max(1, min(n, most))


def keyed(*parts: Column | str) -> Column:
    """Parts joined by colons; null if any part is (as with the || operator)."""
    out = []
    for p in parts:
        out += [F.lit(":"), F.lit(p) if isinstance(p, str) else p.cast("string")]
    return F.concat(*out[1:])


def stable_uuid(text: Column) -> Column:
    """The MD5 of a text in the form of a UUID."""
    h = F.md5(text.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


#: The three characters from each place on, but for those that end in two blanks; one character goes at a time.
_WINDOWS = "(?=(.(?:[^ ].|.[^ ])))."


def trigrams(c: Column) -> Column:
    """The set of trigrams of the lower-cased words, each padded by two blanks before and one after.

    All words with their padding are one text: what spans two of them ends in two blanks, which no trigram does. One
    compiled pattern takes them out, where a lambda a character would be interpreted for each row."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "   "))
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit("  "), words, F.lit(" ")), F.lit(_WINDOWS), F.lit(1)))


def similarity_of(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column) -> Column:
    return similarity_of(trigrams(a), trigrams(b))
