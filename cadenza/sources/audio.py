"""Audio takes: mono samples from WAV files, resampled, and synthetic takes with known mistakes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RATE = 22050


def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, the mean of the channels, and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    kind, scale, shift = {1: ("u1", 128.0, 128.0), 2: ("<i2", 32768.0, 0.0), 4: ("<i4", 2147483648.0, 0.0)}[width]
    x = (np.frombuffer(raw, kind).astype(np.float64) - shift) / scale
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def normalised(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """At the common rate (linear interpolation), without offset, with peak 1."""
    if rate != to and len(x):
        at = np.arange(int(len(x) * to / rate)) * rate / to
        x = np.interp(at, np.arange(len(x)), x)
    x = np.asarray(x, np.float64)
    x = x - x.mean() if len(x) else x
    top = np.abs(x).max() if len(x) else 0.0
    return (x / top if top > 0 else x).astype(np.float32)


def read_onsets(spark: SparkSession, path: str) -> DataFrame:
    """take, onset, t, strength of all WAV files under a path."""

    def detected(batches):
        from cadenza.operators.peaks import onsets

        for pdf in batches:
            rows = []
            for name, data in pdf.itertuples(index=False, name=None):
                x, rate = wav_samples(data)
                rows += [(name.rsplit("/", 1)[-1], k, t, s) for k, (t, s) in enumerate(onsets(normalised(x, rate), RATE))]
            yield pd.DataFrame(rows, columns=["take", "onset", "t", "strength"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(detected, "take string, onset long, t double, strength double")


def tone(number: int, seconds: float, loud: float = 0.5) -> np.ndarray:
    """A struck string: harmonics that fall off with their number and halve every third of a second, higher ones faster, under a rise
    of five milliseconds and a linear end of a fifth."""
    t = np.arange(int(seconds * RATE)) / RATE
    h = np.arange(1, 7)[:, None]
    pitch = 440 * 2 ** ((number - 69) / 12) * h
    halved = 0.5 ** (3 * t * np.sqrt(h))
    voices = np.where(pitch < RATE / 2, np.sin(2 * np.pi * pitch * t) * halved / h, 0.0)
    return loud * np.interp(t, [0, 0.005, 0.8 * seconds, seconds], [0, 1, 1, 0]) * voices.sum(axis=0)


def synthetic(chords: list[list[int]], mistakes: dict[int, tuple[int, int | None]] | None = None, apart: float = 0.6) -> np.ndarray:
    """A take of the chords, one every `apart` seconds after a second of silence. mistakes: for the chord at a place, the note that
    is wrong and what is played instead (none: nothing)."""
    ring = tone(69, 1.0).size
    x = np.zeros(int((1 + apart * len(chords)) * RATE) + 2 * ring)
    for place, notes in enumerate(chords):
        note, instead = (mistakes or {}).get(place, (None, None))
        begin = int((1 + apart * place) * RATE)
        for m in [instead if m == note else m for m in notes]:
            if m is not None:
                x[begin : begin + ring] += tone(m, 1.0)
    return normalised(x, RATE)
