"""Sound as binary columns."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(pcm: bytes, channels: int, source: int, target: int) -> bytes:
    """Linear interpolation of 16-bit samples, clipped."""
    x = np.frombuffer(pcm, dtype="<i2").reshape(-1, channels)
    n = max(1, round(len(x) * target / source))
    at = np.arange(n) * source / target
    axis = np.arange(len(x))
    y = np.stack([np.interp(at, axis, x[:, c]) if len(x) else np.zeros(n) for c in range(channels)], axis=1)
    return np.clip(y, -32768, 32767).astype("<i2").tobytes()


def resampled(pcm: Column, source: Column, target: int, channels: int = 1) -> Column:
    @F.pandas_udf("binary")
    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else resample(x, channels, int(r), target) for x, r in zip(p, s)], dtype=object)

    return run(pcm, source)


def silent_speech(df: DataFrame, keys: list[str], text: str, rate: int = 16_000) -> DataFrame:
    """The stand-in for a speech engine: as many silent frames as the text has characters, 80 at least."""
    frames = F.greatest(F.lit(80), F.length(text))
    pcm = F.unhex(F.repeat(F.lit("0000"), frames.cast("int")))
    return df.select(*keys, pcm.alias("pcm"), F.lit(rate).alias("rate"), frames.cast("bigint").alias("frames"))


def assemble(parts: list[tuple[bytes, int, int]], path: str | None = None, trailing_ms: int = 0) -> bytes:
    """Parts (pcm, rate, pause before in ms) in order as one WAV in the first part's rate."""
    if not parts:
        raise ValueError("no sound to assemble")
    out = io.BytesIO()
    rate = parts[0][1]
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        for pcm, own, pause in parts:
            w.writeframesraw(b"\0\0" * (rate * pause // 1000))
            w.writeframesraw(pcm if own == rate else resample(pcm, 1, own, rate))
        w.writeframesraw(b"\0\0" * (rate * trailing_ms // 1000))
    data = out.getvalue()
    if path:
        with open(path, "wb") as f:
            f.write(data)
    return data
