"""Who coded a record: predicates and labels over coder columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from annoweave.schemas import NOT_CODED


def codes(coder: Column) -> Column:
    """Whether this coder coded. A null coder (no row in the coder's sheet) counts as coding."""
    return ~coder.eqNullSafe(F.lit(NOT_CODED))


def is_coded(*coders: Column) -> Column:
    return reduce(lambda a, b: a | b, [codes(c) for c in coders])


def coding_status(first: Column, second: Column) -> Column:
    n = codes(first).cast("int") + codes(second).cast("int")
    return F.when(n == 0, "neither").when(n == 1, "one_coder").otherwise("both_coders")


def overlap_pair(first: Column, second: Column) -> Column:
    return F.when(codes(first) & codes(second), F.concat(first, F.lit(" + "), second))


def both_labelled(first: Column, second: Column) -> Column:
    return first.isNotNull() & second.isNotNull()


def assigned_coder(there: Column, label: Column, coded_by: Column, owner: Column | str) -> Column:
    """The coder's name for a record, NA if the coder gave no label, null if the coder has no such row."""
    owner = F.lit(owner) if isinstance(owner, str) else owner
    return F.when(there, F.when(label.isNull(), NOT_CODED).otherwise(F.coalesce(coded_by, owner)))
