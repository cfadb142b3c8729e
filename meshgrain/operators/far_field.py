"""Sums of exp(-distance / length) over pairs of far points, by polynomials in place of pairs.

A grid cell's points act on a far cell as if they stood on a few fixed places of their cell, with weights that
interpolate the kernel between those places (Chebyshev interpolation of both ends). The weights are sums over points, so a crowded
cell is summed up where its rows are and costs its pairs of cells no more than another. Cells so far apart that all pairs beyond add up to less
than a given amount are left out, so each cell meets a number of others that grows with the logarithm of the points only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places in a row of a cell; a cell has their square.
PLACES = 10


def _places() -> np.ndarray:
    """Chebyshev points of [-1, 1]."""
    return np.cos((2 * np.arange(PLACES) + 1) * math.pi / (2 * PLACES))


def _shares(u: np.ndarray) -> np.ndarray:
    """How much of a point at u in [-1, 1] falls to each place: (points, places), each row adding up to 1."""
    k = np.arange(1, PLACES)
    here = np.cos(np.arccos(np.clip(u, -1.0, 1.0))[:, None] * k)
    there = np.cos(np.arccos(_places())[:, None] * k)
    return (1 + 2 * here @ there.T) / PLACES


def _in_part(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """(cx, cy, place, w) for the cells of each batch of points."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch[c].to_numpy(zero_copy_only=False) / cell for c in ("x", "y"))
        cells, which = np.unique(np.stack([np.floor(x), np.floor(y)], 1), axis=0, return_inverse=True)
        cx, cy = cells.T
        which = which.reshape(-1)
        across, along = _shares(2 * (x - cx[which]) - 1), _shares(2 * (y - cy[which]) - 1)
        order = np.argsort(which, kind="stable")
        edges = np.r_[np.searchsorted(which[order], np.arange(len(cells))), len(order)]
        for lo in range(0, len(cells), 256):
            hi = min(lo + 256, len(cells))
            w = np.concatenate([(across[r].T @ along[r]).reshape(-1) for r in (order[edges[i] : edges[i + 1]] for i in range(lo, hi))])
            ids = np.repeat(np.arange(lo, hi), PLACES**2)
            yield pa.record_batch({"cx": pa.array(cx[ids].astype(np.int64)), "cy": pa.array(cy[ids].astype(np.int64)), "place": pa.array(np.tile(np.arange(PLACES**2, dtype=np.int32), hi - lo)), "w": pa.array(w)})


def _between(dx: int, dy: int, cell: float, length: float) -> np.ndarray:
    """Kernel between all places of a cell and those of the one dx, dy cells on: rows are places of the first."""
    p = _places() * cell / 2
    x, y = (a.reshape(-1) for a in np.meshgrid(p, p, indexing="ij"))
    return np.exp(-np.hypot(dx * cell + x[None, :] - x[:, None], dy * cell + y[None, :] - y[:, None]) / length)


def _met(batches: Iterator[pa.RecordBatch], cell: float, length: float) -> Iterator[pa.RecordBatch]:
    """(total) of each batch of pairs of cells."""
    for batch in batches:
        if not batch.num_rows:
            continue
        w, v = (np.stack(batch[c].to_numpy(zero_copy_only=False)) for c in ("w", "v"))
        steps, which = np.unique(np.stack([batch["dx"].to_numpy(), batch["dy"].to_numpy()], 1), axis=0, return_inverse=True)
        which, total = which.reshape(-1), 0.0
        for i, (dx, dy) in enumerate(steps):
            rows = which == i
            total += float(np.sum((w[rows] @ _between(int(dx), int(dy), cell, length)) * v[rows]))
        yield pa.record_batch({"total": pa.array([total])})


def far_sum(points: DataFrame, n: int, length: float, cell: float, missed: float) -> float:
    """Sum of exp(-distance / length) over ordered pairs of the n points (x, y) whose grid cells don't touch, less `missed` at most.

    With a cell of four lengths what it returns is within 1e-6 of the sum. Points without finite x and y count for nothing; none at all have the sum 0.
    """
    # n * n pairs at `most` lengths or more add up to less than `missed`
    most = math.log(max(1.0, n * n / missed)) * length / cell
    reach = math.floor(most) + 1
    gap = lambda d: max(abs(d) - 1, 0)
    ahead = [(dx, dy) for dx in range(reach + 1) for dy in range(-reach, reach + 1) if max(dx, abs(dy)) > 1 and (dx > 0 or dy > 0) and math.hypot(gap(dx), gap(dy)) <= most]
    if not ahead:
        return 0.0
    placed = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    parts = placed.mapInArrow(lambda b: _in_part(b, cell), "cx long, cy long, place int, w double")
    cells = parts.groupBy("cx", "cy", "place").agg(F.sum("w").alias("w")).groupBy("cx", "cy").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("w"))
    cells = cells.select("cx", "cy", F.col("w.w").alias("w"))  # one value for each place
    steps = F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in ahead))
    onward = cells.withColumn("step", F.explode(steps)).select((F.col("cx") + F.col("step.dx")).alias("cx"), (F.col("cy") + F.col("step.dy")).alias("cy"), "step.dx", "step.dy", "w")
    pairs = onward.join(cells.withColumnRenamed("w", "v"), ["cx", "cy"]).select("dx", "dy", "w", "v")
    total = pairs.mapInArrow(lambda b: _met(b, cell, length), "total double").agg(F.sum("total")).first()[0]
    return 2 * (total or 0.0)
