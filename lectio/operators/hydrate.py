"""J1 hydration: passage columns joined to a small table of ords.

The passage table is range-partitioned and sorted by ``ord`` and has no partition folders, so its
files follow its bytes and each file's and row group's statistics hold a narrow range of ords. The
keys are summed up as a bounded number of ranges, which reach the Parquet scan as pushed filters:
row groups without a key are skipped by their minima and maxima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

RANGES = 64        # ranges of ords that the keys are summed up in
NEAR = 1024        # ranges closer than this are one
FEW = 1 << 18      # distinct keys that are broadcast, so that no other passage is shuffled


def key_ranges(keys: DataFrame, id_col: str = "ord", ranges: int = RANGES) -> list[tuple[int, int]]:
    """At most ``ranges`` ranges that hold every key; only those reach the driver. A few runs of
    ``NEAR`` ords with keys are taken as they are; more than that are summed up by equal cells of
    the keys' span, each with its least and greatest key."""
    def cut(cell: Column) -> DataFrame:
        return keys.groupBy(cell.cast("long").alias("cell")).agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"))

    rows = cut(F.floor(F.col(id_col) / NEAR)).limit(ranges + 1).collect()
    if len(rows) > ranges:
        ends = keys.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
        wide = (ends["hi"] - ends["lo"]) // ranges + 1
        rows = cut((F.col(id_col) - ends["lo"]) / F.lit(wide)).collect()
    out: list[tuple[int, int]] = []
    for r in sorted((r for r in rows if r["lo"] is not None), key=lambda r: r["lo"]):
        if out and r["lo"] - out[-1][1] <= NEAR:
            out[-1] = (out[-1][0], r["hi"])
        else:
            out.append((r["lo"], r["hi"]))
    return out


def in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(column).between(lo, hi) for lo, hi in ranges), F.lit(False))


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: it is computed once."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def hydrate(keys: DataFrame, passages: DataFrame, cols: list[str], id_col: str = "ord", few: bool = False) -> DataFrame:
    """``keys`` with passage columns; keys without a passage are dropped. The keys are
    written to the shared folder first: that cuts lineage and keeps what made them (the k-NN
    tiles) from running twice. Up to ``FEW`` distinct keys are broadcast to the scan, and only
    the passages that they name are joined. Of ``few`` keys the rows themselves are broadcast, and no
    passage is shuffled."""
    small = written(keys, "keys")
    want = [c for c in dict.fromkeys(cols) if c != id_col and c not in keys.columns]
    side = passages.select(id_col, *want).filter(in_ranges(id_col, key_ranges(small, id_col)))
    if few:
        return F.broadcast(small).join(side, id_col)
    named = small.select(id_col).distinct()
    if named.limit(FEW + 1).count() <= FEW:
        side = side.join(F.broadcast(named), id_col, "left_semi")
    return small.join(side, id_col)
