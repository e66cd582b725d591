"""Left joins that split hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group of at least this share of all rows is hot; so there are at most as many as its inverse.
HOT_SHARE = 0.001


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Below Spark's threshold, which counts compressed bytes, it would be
    broadcast, and the driver would hold many times that; so it isn't, whatever its size."""
    return df.hint("merge")


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which are unique in ``keys`` and count their rows in ``weight``.

    Hot groups, of which there is a bounded number, are broadcast, so that no task gets all rows of one;
    the rest meet in a shuffle. ``weight`` isn't part of the result, and null keys meet nothing.
    """
    least = max(2.0, HOT_SHARE * total)
    made = [c for c in groups.columns if c not in keys and c != weight]
    hot = F.broadcast(groups.filter(F.col(weight) >= least).drop(weight).withColumn("_met", F.lit(True)))
    first = rows.join(hot, keys, "left")
    rest = first.filter("_met IS NULL").drop("_met", *made)
    return first.filter("_met").drop("_met").unionByName(rest.join(shuffled(groups.filter(F.col(weight) < least).drop(weight)), keys, "left"))


def column_of(name: str) -> Column:
    """The column of exactly that name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of a caller's frame as one struct: beside it, helper columns clash with none of them.
    ``select("<its name>.*")`` gives them back as they were."""
    return F.struct(*[column_of(c) for c in df.columns])


def unused(names: list[str], wish: str) -> str:
    """``wish``, with as many underscores after it as set it apart from all ``names`` in any case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish
