"""A score threshold from the data: histogram, smoothing, peaks and valleys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_locus(df: DataFrame, locus: list[str], score: str, out: str = "best") -> DataFrame:
    """The highest score of each locus."""
    return df.groupBy(*locus).agg(F.max(score).alias(out))


def bin_of(score: Column, bins: int) -> Column:
    """Bin from 0 over [0, 1], the last one closed; null outside."""
    return F.when(score.between(0, 1), F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, score: str, bins: int) -> DataFrame:
    """bin and count of every bin, empty ones too; at most ``bins`` rows leave the aggregation."""
    counts = df.select(bin_of(F.col(score), bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(hist: DataFrame, window: int) -> DataFrame:
    """``height``: moving sum over ``window`` bins through ``window``; bins outside count as empty."""
    frame = Window.orderBy("bin").rowsBetween(-(window // 2), (window - 1) // 2)
    return hist.withColumn("height", F.sum("n").over(frame) / F.lit(float(window)))


def extrema(heights: np.ndarray) -> tuple[list[int], list[int]]:
    """Indices of peaks and valleys; a flat one counts at its middle, the left of two."""
    step = np.sign(np.diff(heights))
    slopes = np.flatnonzero(step)
    turns = np.flatnonzero(step[slopes[1:]] != step[slopes[:-1]]) if len(slopes) > 1 else []
    peaks, valleys = [], []
    for t in turns:
        middle = int(slopes[t] + 1 + slopes[t + 1]) // 2
        (peaks if step[slopes[t]] > 0 else valleys).append(middle)
    return peaks, valleys


def shape(loci: int) -> tuple[int, int]:
    """Bins and smoothing window for so many loci."""
    bins = min(150, max(10, math.isqrt(loci)))
    return bins, min(30, max(5, int(bins * 0.2)))


def valley_threshold(heights: np.ndarray, low: float = 0.2, high: float = 0.8) -> float | None:
    """Centre of the lowest valley in [low, high] between the two highest peaks, None if there is none."""
    peaks, valleys = extrema(heights)
    if len(peaks) < 2:
        return None
    left, right = sorted(sorted(peaks, key=lambda i: -heights[i])[:2])
    edges = np.linspace(0.0, 1.0, len(heights) + 1)
    centre = (edges[:-1] + edges[1:]) / 2
    fit = [i for i in valleys if left < i < right and low <= centre[i] <= high]
    return round(float(centre[min(fit, key=lambda i: (heights[i], i))]), 2) if fit else None


def dynamic_threshold(df: DataFrame, locus: list[str], score: str, fallback: float = 0.5, least_loci: int = 100, low: float = 0.2, high: float = 0.8) -> float:
    """Threshold from the best scores of all loci; ``fallback`` with few loci or no clear valley.

    Only the histogram, of at most 150 bins, comes to the driver.
    """
    best = best_per_locus(df, locus, score)
    loci = best.filter(F.col("best").isNotNull()).count()
    if loci < least_loci:
        return fallback
    bins, window = shape(loci)
    heights = np.array([r["height"] for r in smoothed(histogram(best, "best", bins), window).orderBy("bin").collect()])
    found = valley_threshold(heights, low, high)
    return fallback if found is None else found


def above(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) >= threshold)
