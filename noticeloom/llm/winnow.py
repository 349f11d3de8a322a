"""Words, gram hashes and winnowing as Columns: no Python on the path of a row."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: What separates words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = 0x7FFFFFFF


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words in order; none for a null or wordless text. A-Z separate words, so lower them first."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def positions(count: Column) -> Column:
    """0, 1, ... count - 1; empty for a count below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def gram(words: Column, start: Column, length: int) -> list[Column]:
    """The words of a gram; null beyond the end."""
    return [F.get(words, start + at) for at in range(length)]


def sliding_least(values: Column, width: int, count: Column) -> Column:
    """Least of every ``width`` consecutive values, for the first ``count`` starts; width 2 or more."""
    return F.transform(positions(count), lambda at: F.least(*gram(values, at, width)))


def placed_grams(words: Column, length: int) -> Column:
    """Hash and place of every gram in one long: the smaller hash first, of equals the rightmost.

    Fewer words than ``length`` make one gram.
    """
    count = F.when(F.size(words) > 0, F.greatest(F.size(words) - (length - 1), F.lit(1))).otherwise(0)

    def pack(at: Column) -> Column:
        code = F.hash(*gram(words, at, length)).bitwiseAND(F.lit(_LOW)).cast("long")
        return F.shiftleft(code, 32).bitwiseOR((F.lit(_LOW) - at).cast("long"))

    return F.transform(positions(count), pack)


def winnowed(grams: Column, width: int) -> Column:
    """The grams chosen by the least of every ``width`` in a row, in order, each once."""
    count = F.when(F.size(grams) > 0, F.greatest(F.size(grams) - (width - 1), F.lit(1))).otherwise(0)
    return F.array_distinct(sliding_least(grams, width, count))


def gram_codes(chosen: Column) -> Column:
    """Distinct hashes of chosen grams, without their places."""
    return F.array_distinct(F.transform(chosen, lambda one: F.shiftright(one, 32).cast("int")))


def spelled(chosen: Column) -> Column:
    """Chosen grams as text: hash in hex, colon, place; by place."""
    parts = F.transform(
        chosen,
        lambda one: F.concat(
            F.hex(F.shiftright(one, 32)), F.lit(":"), (F.lit(_LOW) - one.bitwiseAND(F.lit(_LOW))).cast("string")
        ),
    )
    return F.array_join(parts, " ")


def likeness(one: Column, other: Column) -> Column:
    """Shared part of two sets, 0 to 1; two empty sets are alike."""
    union = F.size(F.array_union(one, other))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(one, other)) / F.greatest(union, F.lit(1)))
