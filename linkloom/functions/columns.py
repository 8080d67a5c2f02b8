"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it; SQL trim() on its own strips blanks only.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A Column is an expression tree, so reusing one repeats its work. Binding it
    to a lambda variable keeps long derivations linear in size and in cost.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(col: Column) -> Column:
    """Trim every kind of Unicode white space from both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
