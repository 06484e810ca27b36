"""Alignment of signals by normalised cross-correlation, and truth from several sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AWAY = 20


def envelope(samples: np.ndarray, hop: int) -> np.ndarray:
    """Log of the root mean square of each hop."""
    n = samples.size // hop
    return np.log(np.sqrt((samples[: n * hop].astype(float).reshape(n, hop) ** 2).mean(axis=1)) + 1e-6)


def correlate(key: np.ndarray, signal: np.ndarray, away: int = AWAY) -> tuple[int, float, float]:
    """(place, correlation, best correlation ``away`` hops off or more) of a key in a signal; (-1, nan, nan) if longer."""
    m = key.size
    if m == 0 or m > signal.size:
        return -1, np.nan, np.nan
    k = key - key.mean()
    windows = np.lib.stride_tricks.sliding_window_view(signal, m)
    centred = windows - windows.mean(axis=1, keepdims=True)
    ncc = centred @ k / np.maximum(np.linalg.norm(centred, axis=1) * np.linalg.norm(k), 1e-12)
    best = int(np.argmax(ncc))
    rest = np.abs(np.arange(ncc.size) - best) >= away
    return best, float(ncc[best]), float(ncc[rest].max()) if rest.any() else np.nan


def align(pairs: DataFrame) -> DataFrame:
    """offset, ncc, second of pairs (pair_id, key array<double>, signal array<double>), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [correlate(np.asarray(k, float), np.asarray(s, float)) for k, s in zip(b.key, b.signal, strict=True)]
            yield pd.DataFrame({"pair_id": b.pair_id, "offset": [f[0] for f in found], "ncc": [f[1] for f in found], "second": [f[2] for f in found]})

    return pairs.select("pair_id", "key", "signal").mapInPandas(run, "pair_id long, offset int, ncc double, second double")


def verdict(windows: DataFrame, keys: list[str], confident: float = 0.8, spread: float = 1.0) -> DataFrame:
    """Median offset of confident windows and whether they agree within ``spread``."""
    good = windows.where(F.col("ncc") >= confident).groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.median("offset").alias("offset"), (F.max("offset") - F.min("offset")).alias("spread"))
    return good.withColumn("consistent", F.col("spread") <= spread)


def tiers(labels: DataFrame) -> DataFrame:
    """gold if locked, silver with two votes, else bronze."""
    return labels.withColumn("tier", F.when(F.col("locked"), "gold").when(F.col("votes") >= 2, "silver").otherwise("bronze"))


def shift_silver(labels: DataFrame, categories: list[str]) -> DataFrame:
    """Intervals of wanted categories, moved by offset_ms unless they are in target time already."""
    move = F.when(F.coalesce("in_target_time", F.lit(False)), F.lit(0)).otherwise(F.coalesce("offset_ms", F.lit(0)))
    return labels.where(F.col("category").isin(*categories)).select("episode", (F.col("s") + move).alias("s"), (F.col("e") + move).alias("e"), "category")


def merge_truth(host: DataFrame, inserted: DataFrame, durations: DataFrame, late: int = 2000) -> DataFrame:
    """Union of two truth sources (episode, s, e, kind, source), inserted spans at the end made postrolls, with the time
    that each shares with spans of the other source."""
    both = host.unionByName(inserted, allowMissingColumns=True).join(durations, "episode", "left")
    both = both.withColumn("kind", F.when((F.col("source") == "inserted") & (F.col("e") >= F.col("duration_ms") - late), "postroll").otherwise(F.col("kind")))
    return both.withColumn("span_no", F.row_number().over(Window.partitionBy("episode").orderBy("s", "e", "source", "kind")))
