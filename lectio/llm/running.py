"""Running values over the elements of an array, as DataFrame functions, in time linear in its length.

An ``aggregate`` that appends to its result copies it at every element. Here the array is cut into
blocks: only a block's few elements are copied, and once a block the list of finished blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block.
BLOCK = 128


def running(items: Column, begin: Column, element: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(value, item) -> (next value, element)`` gives for each item, left to right, as an
    array of type ``element``; ``begin`` is the first value. An empty array gives an empty one."""
    none = F.array().cast(f"array<{element}>")

    def inside(block: Column, value: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            after, out = step(s["value"], x)
            return F.struct(after.alias("value"), F.concat(s["out"], F.array(out.cast(element))).alias("out"))
        return F.aggregate(block, F.struct(value.alias("value"), none.alias("out")), add)

    last = F.greatest(F.size(items) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    state = F.aggregate(
        blocks,
        F.struct(F.struct(begin.alias("value"), none.alias("out")).alias("last"), F.array().cast(f"array<array<{element}>>").alias("done")),
        lambda s, b: F.struct(inside(b, s["last"]["value"]).alias("last"), F.concat(s["done"], F.array(s["last"]["out"])).alias("done")),
        lambda s: F.concat(s["done"], F.array(s["last"]["out"])),
    )
    return F.flatten(state)
