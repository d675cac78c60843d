"""Column helpers shared by the operators of this subpackage (JVM-side expressions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once instead of once for each use."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` runs of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def unit(bits: Column) -> Column:
    """A long as a number in the open interval (0, 1)."""
    return (F.shiftrightunsigned(bits, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def placed(items: Column, value: Callable[[Column], Column], place: Callable[[Column], Column], kind: str) -> Column:
    """An array with the value of each item at the item's place, and nulls between; items come by place, from 0, each place once.

    Reading it at a place takes a step, where looking through the items takes one for each of them.
    """

    def stretches(own: Column) -> Column:
        def stretch(x: Column, i: Column) -> Column:
            before = F.coalesce(place(F.get(own, i - 1)), F.lit(-1))
            return F.concat(F.array_repeat(F.lit(None).cast(kind), place(x) - before - 1), F.array(value(x)))

        return F.flatten(F.transform(own, stretch))

    return let(items, stretches)
