"""Density-equalising maps: one dense solver a metric, metrics side by side.

A flow carries grid nodes from dense to sparse places. Longitude is periodic, latitude reflects: the
potential of the flow is solved by Fourier transforms, with latitude mirrored. Each metric is one
group, solved in one task; a grid has a fixed size, so a group does too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flux(density: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient, by columns and rows, of the potential whose Laplacian is mean minus density."""
    h, w = density.shape
    mirrored = np.concatenate([density, density[::-1]])
    ky, kx = 2 * np.pi * np.fft.fftfreq(2 * h)[:, None], 2 * np.pi * np.fft.fftfreq(w)[None, :]
    k2 = kx**2 + ky**2
    k2[0, 0] = 1
    potential = np.fft.fft2(mirrored - mirrored.mean()) / k2
    gx, gy = (np.real(np.fft.ifft2(1j * k * potential))[:h] for k in (kx, ky))
    return -gx, -gy


def blur(density: np.ndarray, sigma: float) -> np.ndarray:
    h, w = density.shape
    mirrored = np.fft.fft2(np.concatenate([density, density[::-1]]))
    ky, kx = 2 * np.pi * np.fft.fftfreq(2 * h)[:, None], 2 * np.pi * np.fft.fftfreq(w)[None, :]
    return np.real(np.fft.ifft2(mirrored * np.exp(-(kx**2 + ky**2) * sigma**2 / 2)))[:h]


def sample(field: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear between cell centres; columns wrap, rows are held."""
    h, w = field.shape
    x, y = x - 0.5, np.clip(y - 0.5, 0, h - 1)
    j, i = np.floor(x).astype(int), np.minimum(np.floor(y).astype(int), max(h - 2, 0))
    fx, fy = x - j, y - i
    i1 = np.minimum(i + 1, h - 1)
    return (1 - fy) * ((1 - fx) * field[i, j % w] + fx * field[i, (j + 1) % w]) + fy * ((1 - fx) * field[i1, j % w] + fx * field[i1, (j + 1) % w])


def solve(density: np.ndarray, sigma: float = 1.0, tolerance: float = 0.01, most_steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Where the grid's nodes (h + 1 by w + 1) end: columns and rows. A predictor and a corrector set the step."""
    h, w = density.shape
    rho = blur(density / density.mean(), sigma)
    rho = np.maximum(rho, 1e-3)
    rho /= rho.mean()
    gx, gy = flux(rho)
    x, y = np.meshgrid(np.arange(w + 1, dtype=float), np.arange(h + 1, dtype=float))

    def speed(x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        d = (1 - t) * sample(rho, x, y) + t
        edge = np.clip(np.minimum(y, h - y) / 0.5, 0, 1)  # nothing flows over a pole
        return sample(gx, x, y) / d, sample(gy, x, y) / d * edge

    t, step = 0.0, 0.01
    for _ in range(most_steps):
        if t >= 1:
            break
        step = min(step, 1 - t)
        ux, uy = speed(x, y, t)
        px, py = x + step * ux, np.clip(y + step * uy, 0, h)
        vx, vy = speed(px, py, t + step)
        qx, qy = x + step * (ux + vx) / 2, np.clip(y + step * (uy + vy) / 2, 0, h)
        error = max(np.abs(qx - px).max(), np.abs(qy - py).max(), 1e-12)
        if error <= tolerance and (cell_areas(qx, qy) > 0).all():
            x, y, t = qx, qy, t + step
            step *= max(0.5, min(2.0, 0.9 * (tolerance / error) ** 0.5))
        else:
            step *= max(0.1, min(0.5, 0.8 * (tolerance / error) ** 0.5))
    if t < 1:
        raise RuntimeError(f"the map is not equalised after {most_steps} steps (time {t:.3f} of 1)")
    return x, y


def cell_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the mapped cells, as the two triangles of each."""
    dx1, dy1, dx2, dy2 = x[1:, 1:] - x[:-1, :-1], y[1:, 1:] - y[:-1, :-1], x[1:, :-1] - x[:-1, 1:], y[1:, :-1] - y[:-1, 1:]
    return (dx1 * dy2 - dy1 * dx2) / 2


def cartogram(cells: DataFrame, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """(metric, r, c, x, y, area) of each cell's north-west node and mapped area; cells: (metric, r, c, density), each metric's mean elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((height, width), pdf["density"].mean())
        grid[pdf["r"], pdf["c"]] = pdf["density"]
        x, y = solve(grid, sigma)
        r, c = np.mgrid[:height, :width]
        return pd.DataFrame({"metric": pdf["metric"].iloc[0], "r": r.ravel(), "c": c.ravel(), "x": np.round(x[:-1, :-1].ravel(), 6), "y": np.round(y[:-1, :-1].ravel(), 6), "area": np.round(cell_areas(x, y).ravel(), 9)})

    return cells.groupBy("metric").applyInPandas(run, "metric string, r int, c int, x double, y double, area double")


def mapped_areas(mapped: DataFrame, labels: DataFrame) -> DataFrame:
    """(metric, lab, area, cells): the area of each label on the map; a cell that was turned over is an error."""
    checked = F.when(F.col("area") > 0, F.col("area")).otherwise(F.raise_error(F.lit("a mapped cell was turned over")).cast("double"))
    return mapped.join(labels, ["r", "c"]).groupBy("metric", "lab").agg(F.round(F.sum(checked), 6).alias("area"), F.count("*").alias("cells"))
