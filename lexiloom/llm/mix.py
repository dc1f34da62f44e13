"""Mixing sources to target weights that change during training.

Every source has a weight schedule over progress t in [0, 1], piecewise linear. Its token demand up to
t is the integral of weight / sum of weights, times the budget. Documents of a source stand in a
seeded order; the demand is inverted at the tokens before a document, which gives its training position.
A document's tokens are its bytes in UTF-8 / 4, rounded up. Cumulative tokens come from a histogram of ``bins`` equal parts of each source's
order (interpolated inside a part), so a position is a lookup: no document is shuffled until the last step, a range sort by position.

Histograms and demands stay tables with a row for each source, however many sources there are; only sums over all sources (a number for each of
STEPS points) go to the driver. The table is broadcast while it has BROADCAST_ROWS rows at most (2.6 kB each); a larger one is joined by source.

Two modes
* ``budget`` tokens: a source with more tokens than its demand is cut where the demand ends; one with
  fewer begins again (epoch 1, 2, ...) until the demand is met, so target weights hold.
* ``budget=None``: every document is placed once, in epoch 0; schedules shape the order only.

Defined results: null or empty text counts as one token (so it has a place); a null source is a source of its
own, with the default schedule; equal documents and repeated rows are placed one by one (equal keys have equal positions);
null doc_id has the key ''; empty input gives no rows; all input columns are kept, those named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remote

BINS, STEPS, SEED = 64, 256, 17
BROADCAST_ROWS = 8_192
ADDED = ("epoch", "position")


def schedule_on(points: list[tuple[float, float]], grid: np.ndarray) -> np.ndarray:
    p = sorted(points)
    return np.interp(grid, [t for t, _ in p], [max(w, 0.0) for _, w in p])


def weights(source: str | None, tokens: float, total: float, schedules: dict, start_power: float, end_power: float) -> np.ndarray:
    """A source's weight at each grid point; unlisted sources have share of tokens ** power, the power going from start to end."""
    grid = np.linspace(0, 1, STEPS + 1)
    return schedule_on(schedules[source], grid) if source in schedules else (tokens / max(total, 1)) ** (start_power + (end_power - start_power) * grid)


def demand(weight: np.ndarray, every: np.ndarray, tokens: float, budget: float | None) -> np.ndarray:
    """Cumulative tokens asked of a source at each grid point, ``every`` being the sum of all sources' weights."""
    rate = weight / np.where(every > 0, every, 1.0)
    area = np.concatenate([[0.0], np.cumsum((rate[1:] + rate[:-1]) / 2) / STEPS])
    if budget is None:
        return (area / area[-1] if area[-1] > 0 else np.linspace(0, 1, STEPS + 1)) * tokens
    return area * budget


def weight_sums(batches, schedules, total, start_power, end_power):
    """Sums over a partition's sources of their weights."""
    sums = np.zeros(STEPS + 1)
    for b in batches:
        for s, bins in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums += weights(s, float(sum(x["n"] for x in bins)), total, schedules, start_power, end_power)
    yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])


def plans(batches, schedules, total, every, budget, start_power, end_power, bins):
    """A row for each source: tokens before each bin, epochs wanted, cumulative demand."""
    every = np.array(every)
    for b in batches:
        before, epochs, wants = [], [], []
        for s, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = np.zeros(bins)
            for x in found:
                n[x["b"]] = x["n"]
            tokens = float(n.sum())
            want = demand(weights(s, tokens, total, schedules, start_power, end_power), every, tokens, budget)
            before.append(np.concatenate([[0.0], np.cumsum(n)]))
            epochs.append(want[-1] / tokens if budget is not None else 1.0)
            wants.append(want)
        floats = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before, floats), pa.array(epochs, pa.float64()), pa.array(wants, floats)], ["__s", "__before", "__epochs", "__want"])


def _key(key: str, seed: int):
    """A number in [0, 2**32) that orders a source's documents."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _tokens(text: str):
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 3) / 4)).cast("long")


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", schedules: dict | None = None, budget: str | float | None = "all",
        start_power: float = 1.0, end_power: float = 0.5, bins: int = BINS, seed: int = SEED, sort: bool = True) -> DataFrame:
    """``docs`` with epoch (int) and position (double, 0 to 1), sorted by position. ``budget='all'``: as many tokens as the input has."""
    lookup, how = plan(docs, source, key, text, schedules, budget, start_power, end_power, bins, seed)
    return place(docs, lookup, **how, source=source, key=key, sort=sort)


def plan(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", schedules: dict | None = None, budget: str | float | None = "all",
         start_power: float = 1.0, end_power: float = 0.5, bins: int = BINS, seed: int = SEED) -> tuple[DataFrame, dict]:
    """All that is decided about ``docs``: a row for each source, and the other arguments of ``place`` (which JSON can hold)."""
    src, h = F.col(f"`{source}`").cast("string"), _key(key, seed)
    width = (1 << 32) / bins
    rows = docs.select(src.alias("s"), F.floor(h / width).cast("int").alias("b"), _tokens(text).alias("n")).groupBy("s", "b").agg(F.sum("n").alias("n"))
    hist = cut(rows.groupBy("s").agg(F.collect_list(F.struct("b", "n")).alias("bins")))  # at most ``bins`` entries each
    sources, total = hist.select(F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    how = {"schedules": schedules or {}, "total": total, "start_power": start_power, "end_power": end_power}
    sums = hist.mapInArrow(remote(__name__, "weight_sums", **how), "sums array<double>").select(F.posexplode("sums").alias("g", "w")).groupBy("g").agg(F.sum("w").alias("w"))
    every = np.zeros(STEPS + 1)
    for g, w in sums.collect():
        every[g] = w
    how |= {"every": every.tolist(), "budget": total if budget == "all" else budget, "bins": bins}
    lookup = hist.mapInArrow(remote(__name__, "plans", **how), "__s string, __before array<double>, __epochs double, __want array<double>")
    return lookup, {"sources": sources, "bounded": budget is not None, "bins": bins, "seed": seed}


def place(docs: DataFrame, lookup: DataFrame, sources: int, bounded: bool, bins: int = BINS, seed: int = SEED, source: str = "source", key: str = "doc_id", sort: bool = True) -> DataFrame:
    """``docs`` with epoch and position as planned."""
    src, h = F.col(f"`{source}`").cast("string"), _key(key, seed)
    width = (1 << 32) / bins
    # the document travels as one struct, so no column of it can meet the columns added here
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("row"), F.col(f"`{key}`").alias("__key"), src.alias("__source"), h.alias("__h"))
    joined = base.join(F.broadcast(lookup) if sources <= BROADCAST_ROWS else lookup, F.col("__source").eqNullSafe(F.col("__s")))
    bin_ = F.least(F.floor(F.col("__h") / width), F.lit(bins - 1)).cast("int")
    lo, hi = F.element_at("__before", bin_ + 1), F.element_at("__before", bin_ + 2)
    at = lo + (hi - lo) * (F.col("__h") / width - bin_)
    joined = joined.withColumn("__at", at).withColumn("__total", F.element_at("__before", -1))
    if not bounded:
        epochs = F.array(F.lit(0))
    else:  # epoch e of a document asks for tokens e * total + at, which the demand must reach
        last = F.floor(F.col("__epochs") - F.col("__at") / F.col("__total"))
        last = F.when(last * F.col("__total") + F.col("__at") < F.element_at("__want", -1), last).otherwise(last - 1).cast("int")
        epochs = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    placed = joined.withColumn("epoch", F.explode(epochs)).withColumn("__asked", F.col("epoch") * F.col("__total") + F.col("__at"))
    # the demand is increasing: the first grid point beyond what is asked, by bisection without a loop over rows
    grid = F.lit(0)
    step = STEPS
    while step:
        ahead = F.least(grid + step, F.lit(STEPS))
        grid = F.when(F.element_at("__want", ahead + 1) <= F.col("__asked"), ahead).otherwise(grid)
        placed = placed.withColumn("__g", grid)
        grid = F.col("__g")
        step //= 2
    g = F.least(F.col("__g"), F.lit(STEPS - 1))
    a, b = F.element_at("__want", g + 1), F.element_at("__want", g + 2)
    inside = F.when(b > a, (F.col("__asked") - a) / (b - a)).otherwise(F.lit(0.0))
    out = placed.withColumn("position", F.round((g + F.least(inside, F.lit(1.0))) / STEPS, 12))
    out = out.orderBy("position", "epoch", "__key") if sort else out
    return out.select("row.*", F.col("epoch").cast("int").alias("epoch"), "position")
