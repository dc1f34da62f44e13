"""Sharding by consistent hashing with bounded loads.

A ring of 2**64 places holds ``vnodes`` points for each shard, so points don't collide however many shards there are. A key's arc is
the first point at or after its own place: a table by the first bits of the place leads to the points that are left to compare. No shard takes more than ``ceil((1 + slack) * rows / shards)`` rows; a key whose
shard is full goes on clockwise to the next point of a shard that is not.

Keys are inserted in a fixed order that needs no arrival time: by (slice, arc, order hash, key),
slice being the top bits of the order hash. So a whole (slice, arc) cell is placed with one count, and
the ring is played through on the counts of cells alone: at most 2**SLICE_BITS * shards * vnodes numbers, whatever
the data's size. Only a cell in which a shard fills up (at most one a shard) needs ranks of its rows.

Defined results: a null key is treated as the key ''; equal keys get one arc and may be parted only
where their cell is cut; empty input gives no rows; text and any other columns are carried untouched.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 5
SHARDS, VNODES, SLACK = 16, 64, 0.05
CUT = 1 << 23


def place_of(key: str) -> str:
    """A place as 16 hexadecimal digits, which sort as numbers do."""
    return hashlib.md5(key.encode()).hexdigest()[:16]


def ring(shards: int, vnodes: int) -> list[tuple[str, int]]:
    """(place, shard) of all points in ring order. A shard's points do not depend on the number of shards."""
    at: dict[str, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(place_of(f"shard-{s}-{v}"), s)
    return sorted(at.items())


def arc_of(digest: Column, places: list[str]) -> Column:
    """The first of ``places`` that is not before a digest's place, going round: a lookup by leading digits, then as many comparisons as the fullest part of the table has points."""
    digits = max(2, math.ceil((math.log2(len(places)) + 2) / 4))
    first = [bisect_left(places, f"{x:0{digits}x}") for x in range(16**digits + 1)]
    most = max(b - a for a, b in zip(first, first[1:]))
    low = _at(first[:-1], _hex(digest, 1, digits), 4)
    table = F.lit(bytearray(bytes.fromhex("".join(places)) + b"\xff" * 8 * most))  # bytes are found at once; characters would be counted from the first on
    place = F.unhex(F.substring(digest, 1, 16))
    return sum(((F.substring(table, (low + k) * 8 + 1, F.lit(8)) < place).cast("int") for k in range(most)), low) % len(places)


def simulate(cells: dict[tuple[int, int], int], points: list[tuple[int, int]], shards: int, capacity: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each (slice, arc) cell the (rows, shard) runs in which its rows are placed, in the order of insertion."""
    load = [0] * shards
    target = [s for _, s in points]
    full: set[int] = set()
    out = {}
    for cell in sorted(cells):
        left, runs = cells[cell], []
        while left:
            s = target[cell[1]]
            take = min(left, capacity - load[s])
            if take:
                runs.append((take, s))
                load[s] += take
                left -= take
            if load[s] == capacity and len(full) < shards - 1 and s not in full:
                full.add(s)
                following = None
                for i in [*range(len(points) - 1, -1, -1), *range(len(points) - 1, -1, -1)]:  # nearest point clockwise that has room
                    if points[i][1] not in full:
                        following = points[i][1]
                    if following is not None:
                        target[i] = following
        out[cell] = runs
    return out


def _at(table: list[int], index: Column, size: int) -> Column:
    """``table[index]``, the table being one binary literal: a slice of ``size`` bytes, read as a number."""
    packed = bytearray(b"".join(x.to_bytes(size, "big") for x in table))
    return F.conv(F.hex(F.substring(F.lit(packed), index * size + 1, F.lit(size))), 16, 10).cast("int")


def _hex(c: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(c, first, digits), 16, 10).cast("int")


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK, column: str = "shard") -> DataFrame:
    """``docs`` with the integer column ``column``, every other column kept (one of that name is replaced)."""
    points = ring(shards, vnodes)
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    order = _hex(digest, 17, 6)
    arc = arc_of(digest, [p for p, _ in points])
    cell = F.struct(F.shiftright(order, 24 - SLICE_BITS).alias("slice"), arc.alias("arc"))
    counts = docs.select(cell.alias("c")).groupBy("c.slice", "c.arc").count()
    cells = {(r[0], r[1]): r[2] for r in counts.toLocalIterator()}
    rows = sum(cells.values())
    runs = simulate(cells, points, shards, max(1, math.ceil((1 + slack) * rows / shards)))
    # whole cells: a lookup in a literal of fixed size, slice * arcs + arc
    table = [0] * ((1 << SLICE_BITS) * len(points))  # 0: empty; below CUT: a shard, plus 1; above: a cut cell
    cutcells = []
    for (s, a), r in runs.items():
        if len(r) == 1:
            table[s * len(points) + a] = r[0][1] + 1
        else:
            table[s * len(points) + a] = CUT + len(cutcells)
            cutcells.append(r)
    number = F.shiftright(order, 24 - SLICE_BITS) * len(points) + arc
    # the document travels as one struct, so no column of it can meet the columns added here
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != column]).alias("row")
    placed = docs.select(keep, _at(table, number, 3).alias("cell"), order.alias("order"), F.col(f"`{key}`").alias("key"))
    whole = placed.where(F.col("cell") < CUT).select("row.*", (F.col("cell") - 1).alias(column))
    if not cutcells:
        return whole
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("order", F.col("key").asc_nulls_first()))
    case = F.lit(None).cast("int")
    for k, r in enumerate(cutcells):
        below, pick = 0, F.lit(r[-1][1])
        ends = []
        for n, s in r:
            below += n
            ends.append((below, s))
        for end, s in reversed(ends[:-1]):
            pick = F.when(F.col("rank") <= end, s).otherwise(pick)
        case = F.when(F.col("cell") == CUT + k, pick).otherwise(case)
    parted = placed.where(F.col("cell") >= CUT).withColumn("rank", rank).select("row.*", case.alias(column))
    return whole.unionByName(parted)
