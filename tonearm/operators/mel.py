"""Log-mel frames of waves of any length, block by block.

A wave is rows of samples (key, block, samples), ``BLOCK`` frames' worth each
but the last. A frame spans two hops, so a block is given the first samples of
the next one; no frame is lost or made twice at a seam, and a task holds one
batch of blocks. Frames are cut as a matrix, transformed at once, and weighted
by the mel triangles, of which each has few bins: sums over cumulative bins
would lose digits, so a triangle's own bins are multiplied.

Defined cases: a wave of fewer than one frame's samples has no frame; null
samples count as silence; null waves have none; repeated blocks are waves
that overlap, and give their frames each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

# Samples a second, samples of a frame and between frames, bands, and what a power is multiplied by before the logarithm.
RATE, FRAME, HOP, BANDS, GAIN = 16_000, 512, 256, 96, 10_000.0
# Fixed values of the mel scale: linear steps of LINEAR Hz up to KNEE Hz, above it LOG_STEPS steps for each factor of LOG_BASE.
LINEAR, KNEE, LOG_BASE, LOG_STEPS = 200 / 3, 1000.0, 6.4, 27
#: Frames of a block.
BLOCK = 1024


def edges() -> np.ndarray:
    """The bands' BANDS + 2 corners in Hz, equally far from each other on the mel scale, from 0 to half the rate."""
    knee = KNEE / LINEAR
    top = knee + LOG_STEPS * np.log(RATE / 2 / KNEE) / np.log(LOG_BASE)
    mel = np.linspace(0, top, BANDS + 2)
    return np.where(mel < knee, mel * LINEAR, KNEE * LOG_BASE ** ((mel - knee) / LOG_STEPS))


@functools.cache
def triangles() -> list[tuple[int, np.ndarray]]:
    """Per band its first bin and the weights from there on: a triangle over its corners with an area of one."""
    hz, corner, out = np.arange(FRAME // 2 + 1) * RATE / FRAME, edges(), []
    for a, b, c in zip(corner, corner[1:], corner[2:]):
        inside = np.flatnonzero((hz > a) & (hz < c))
        rise, fall = (hz[inside] - a) / (b - a), (c - hz[inside]) / (c - b)
        out.append((int(inside[0]) if len(inside) else 0, np.minimum(rise, fall) * 2 / (c - a)))
    return out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames of consecutive samples as rows of BANDS numbers."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    cut = np.stack([samples[h * HOP :][: n * HOP].reshape(n, HOP) for h in range(FRAME // HOP)], 1).reshape(n, FRAME) if n else np.zeros((0, FRAME))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))
    wave = np.fft.rfft(cut * window, axis=1)
    power = wave.real**2 + wave.imag**2
    out = np.empty((n, BANDS))
    for band, (first, weight) in enumerate(triangles()):
        out[:, band] = power[:, first : first + len(weight)] @ weight
    return np.log10(1 + GAIN * out).astype(np.float32)


def blocks(waves: DataFrame, key: str = "key") -> DataFrame:
    """(key, block, samples) of whole waves (key, samples)."""
    size = BLOCK * HOP
    many = F.greatest(F.ceil(F.size("samples") / size), F.lit(1)).cast("int")
    return waves.where("samples is not null").select(F.col(key).alias("key"), F.posexplode(F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.slice("samples", b * size + 1, F.lit(size)))).alias("block", "samples"))


def frames(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """(key, frame, mel) of the blocks (key, block, samples) of waves."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, block, own, tail in zip(batch["key"], batch["block"], batch["samples"], batch["tail"]):
                wave = np.nan_to_num(np.concatenate([np.asarray(x, float) for x in (own, tail) if x is not None]))
                mel = log_mel(wave)[:BLOCK]
                if len(mel):
                    yield pd.DataFrame({"key": key, "frame": int(block) * BLOCK + np.arange(len(mel)), "mel": list(mel)})

    heads = parts.select("key", (F.col("block") - 1).alias("block"), F.slice("samples", 1, FRAME - HOP).alias("tail"))
    kind = parts.schema["key"].dataType.simpleString()
    return parts.join(heads, ["key", "block"], "left").select("key", "block", "samples", "tail").mapInPandas(run, f"key {kind}, frame bigint, mel array<float>")
