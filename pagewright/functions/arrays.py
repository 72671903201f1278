"""Arrays in one pass: runs between starting points, and folds that give values off as they go.

``aggregate`` copies its whole state at every step, so a fold whose state holds its results takes quadratic time. Here a
fold runs over blocks of items, and within each over its items: a step copies the block's results at most, and only a
block all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Items of a block.
BLOCK = 256


def indices(items: Column) -> Column:
    """0 to the number of items less one; none of no items."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def runs(items: Column, starts: Callable[[Column], Column]) -> Column:
    """The items cut before each place where ``starts`` (of its index) holds; the first always starts one."""
    cut = F.filter(indices(items), lambda i: (i == 0) | starts(i))
    return let(cut, lambda at: F.transform(at, lambda s, k: F.slice(items, s + 1, F.coalesce(F.get(at, k + 1), F.size(items)) - s)))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str, rest: Callable[[Column], Column] | None = None) -> Column:
    """Array of what the steps give off. ``step(state, item)``: a struct of the next ``state`` and a ``value`` of type
    ``kind``, null for none; ``rest(state)``: what is left at the end, an array."""

    empty = F.array().cast(f"array<{kind}>")
    begun = lambda state: F.struct(F.struct(state.alias("state"), F.lit(None).cast(kind).alias("value")).alias("at"), empty.alias("out"))
    put = lambda acc: F.when(acc["at"]["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["at"]["value"])))

    def move(acc: Column, x: Column) -> Column:
        # A value is put away by the step after its own, so that no step is worked out twice.
        return F.struct(step(acc["at"]["state"], x).alias("at"), put(acc).alias("out"))

    def over(acc: Column, block: Column) -> Column:
        found = F.aggregate(block, begun(acc["state"]), move, lambda own: F.struct(own["at"]["state"].alias("state"), put(own).alias("out")))
        return let(found, lambda own: F.struct(own["state"].alias("state"), F.concat(acc["out"], own["out"]).alias("out")))

    def through(items: Column) -> Column:
        # Of one block at most, as most arrays are: a plain fold.
        short = F.aggregate(items, begun(zero), move, lambda own: F.concat(put(own), rest(own["at"]["state"])) if rest else put(own))
        blocks = F.transform(F.filter(indices(items), lambda i: i % BLOCK == 0), lambda i: F.slice(items, i + 1, F.lit(BLOCK)))
        close = lambda acc: F.concat(acc["out"], rest(acc["state"])) if rest else acc["out"]
        return F.when(F.size(items) <= BLOCK, short).otherwise(F.aggregate(blocks, F.struct(zero.alias("state"), empty.alias("out")), over, close))

    return let(items, through)
