"""Views kept up to date by increments of signed rows: an insert counts 1, a delete -1, an update is both.

Counts, sums and postings are sums of signed rows, so a view's next state is its last one and the increment's own aggregate, added by key; what comes to nothing goes.
Only the keys of the increment are recomputed, though the state is written anew (a Published table): a batch that runs again changes nothing.

Defined results: a null key is a key; a delete of what isn't there leaves a negative count, which check() tells; sums of doubles are those of the order in which they were added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.sources.published import Published

SIGN = "sign"


def counted(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Of signed rows, by key: n, and the sum of each column."""
    return rows.groupBy(*by).agg(F.sum(SIGN).alias("n"), *[F.sum(F.col(c) * F.col(SIGN)).alias(c) for c in sums])


def posted(rows: DataFrame) -> DataFrame:
    """Of signed documents (id, text): the postings term, id and tf, signed."""
    return rows.select("id", SIGN, F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.sum(SIGN).alias("n"))


def added(state: DataFrame | None, change: DataFrame, by: list[str]) -> DataFrame:
    """The state with a change: both are sums by key."""
    if state is None:
        return change.filter("n != 0")
    rest = [c for c in change.columns if c not in by]
    return state.select(*change.columns).unionByName(change).groupBy(*by).agg(*[F.sum(c).alias(c) for c in rest]).filter("n != 0")


class View:
    """A view at a folder: make gives an increment's own aggregate (with n), which is added by the columns by."""

    def __init__(self, spark: SparkSession, root: str, by: list[str], make: Callable[[DataFrame], DataFrame]) -> None:
        self.table, self.by, self.make = Published(spark, root), by, make

    def apply(self, batch: int, rows: DataFrame) -> bool:
        """Take in the signed rows of a batch; False if it had been taken in before."""
        return self.table.load(batch, lambda state: added(state, self.make(rows), self.by))

    def read(self) -> DataFrame:
        return self.table.read()

    def check(self) -> DataFrame:
        """The keys of which more was deleted than there was."""
        return self.read().filter("n < 0")
