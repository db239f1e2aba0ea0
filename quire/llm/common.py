"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.folders import shared_dir

#: Fixed value: the white space of every contract here, as a regular-expression class body.
WHITE = r"\x20\x09-\x0D"

#: A key is heavy if it holds more than a HEAVY-th of all rows. So fewer than HEAVY keys are, whatever the size of the
#: table, and a table of heavy keys alone may be broadcast.
HEAVY = 4096

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def is_heavy(total: int, n: str = "n") -> Column:
    """Whether a key with `n` of `total` rows is heavy."""
    return F.col(n) * HEAVY > total


def join_by_count(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, how: str = "inner", n: str = "n") -> DataFrame:
    """rows joined with keyed, which has one row a key and in `n` how many of the `total` rows have it; the column n goes.

    The rows of heavy keys stay where they are and meet a broadcast table of fewer than HEAVY rows. All others meet by a
    sort-merge join, so no task gets more than a HEAVY-th of the rows from one key. The plan is the same at every size.
    Both sides are read twice: cut them first if they are dear.
    """
    heavy = F.broadcast(keyed.where(is_heavy(total, n)).drop(n))
    light = rows.join(F.broadcast(keyed.where(is_heavy(total, n)).select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(light.join(keyed.where(~is_heavy(total, n)).drop(n).hint("merge"), on, how))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; no other letter changes."""
    return let(c, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, UPPER.lower())))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]
