"""Order-preserving alignment of an expected and an observed sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SKIP = 0.5


#: Gains are rounded to this, so that sums are exact and equal scores are equal numbers.
GRAIN = 2.0**-30


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x / GRAIN) * GRAIN


def _table(presence: np.ndarray, late_start: float) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of all prefixes and the gains of all pairs, a row at a time: what skipped observed rows leave of a place to the
    left is a running maximum once each place is raised by what the skips up to it cost. late_start is the price of each expected
    row before the first pair."""
    gain = _rounded(2 * presence - 0.8)
    n, k = gain.shape
    price = SKIP * np.arange(k + 1)
    best = np.zeros((n + 1, k + 1))
    best[:, 0] = _rounded(-late_start * np.arange(n + 1))
    for above, row, own in zip(best, best[1:], gain):
        row[1:] = np.maximum(above[:-1] + own, above[1:] - SKIP)
        row[:] = np.maximum.accumulate(row + price) - price
    return best, gain


def _pairs(best: np.ndarray, gain: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """The way back from a place. Scores are exact, so they tell where each came from; equal ways: pair, then skipped expected."""
    found = []
    while i and j:
        i, j = i - 1, j - 1
        if best[i + 1, j + 1] == best[i, j] + gain[i, j]:
            found.append((i, j))
        elif best[i + 1, j + 1] == best[i, j + 1] - SKIP:
            j += 1
        else:
            i += 1
    return found[::-1]


def align(presence: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """Pairs (expected, observed) of the best alignment of a presence matrix, and its score.

    A pair is worth 2 * presence - 0.8, a skip of either side costs SKIP; skips before the first pair and after the last are free.
    Equal scores: pair, then skipped expected, then skipped observed; the end is the first best place of the last row, then of the
    last column. Time and memory are the product of both lengths."""
    best, gain = _table(presence, 0.0)
    i, j = int(best[:, -1].argmax()), int(best[-1].argmax())
    if best[-1, j] >= best[i, -1]:
        i = len(best) - 1
    else:
        j = best.shape[1] - 1
    return _pairs(best, gain, i, j), float(best[i, j])


def align_suffix(presence: np.ndarray, anchored: bool) -> tuple[list[tuple[int, int]], float]:
    """Pairs that use up all observed rows, and their score: expected rows may be left over at the end. Without an anchor a late
    start is cheap. Equal scores end at the first expected row."""
    best, gain = _table(presence, SKIP if anchored else 0.1)
    i = int(best[:, -1].argmax())
    return _pairs(best, gain, i, best.shape[1] - 1), float(best[i, -1])


def aligned(expected: DataFrame, observed: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the expected rows (numbered from 0) with the observed row that they are aligned with, and ok, wrong or skipped.

    The programme is quadratic in a key's rows, so keys are takes or pieces of bounded length."""
    kind = expected.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, expected long, observed long, status string"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # a side without rows comes without columns
        a, b = (x.sort_values([order, value])[value].to_numpy() if order in x.columns else np.zeros(0) for x in (left, right))
        pairs = dict(align((a[:, None] == b[None, :]).astype(float))[0]) if len(a) and len(b) else {}
        rows = [(left[key].iloc[0], i, pairs.get(i), "skipped" if i not in pairs else "ok" if a[i] == b[pairs[i]] else "wrong") for i in range(len(a))]
        out = pd.DataFrame(rows, columns=[key, "expected", "observed", "status"])
        return out.astype({"expected": "Int64", "observed": "Int64"})

    return expected.groupBy(key).cogroup(observed.groupBy(key)).applyInPandas(run, schema)


def play_order(measures: list[dict]) -> list[int]:
    """Measure places in the order they are played. The first bar that holds a dal segno (if there is a segno) or a da capo jumps
    back, once, the former rather than the latter; only after that to-coda (if there is a coda) leads on, and a fine of a bar
    without it ends. The last segno and coda count; 10,000 bars at most."""
    last = {name: k for k, m in enumerate(measures) for name in ("segno", "coda") if m.get(name)}

    def back(m: dict) -> int | None:
        return last["segno"] if m.get("dalsegno") and "segno" in last else 0 if m.get("dacapo") else None

    turn = next((k for k, m in enumerate(measures) if back(m) is not None), None)
    if turn is None:
        return list(range(len(measures)))[:10_000]
    out, k = list(range(turn + 1)), back(measures[turn])
    while k < len(measures) and len(out) < 10_000:
        out.append(k)
        if measures[k].get("tocoda") and "coda" in last:
            k = last["coda"]
        elif measures[k].get("fine"):
            break
        else:
            k += 1
    return out[:10_000]


def played(onsets: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows of `onsets` in play order: play_pos counts the bars played, and a bar played twice comes twice.

    flags: score_id, measure_idx, flags (array of jump names); one row per bar, the bars of one score in one task. Null flags are
    none; a score without rows in `flags` has no play order and no rows; onsets of bars that aren't in `flags` go."""
    kind = flags.schema["score_id"].dataType.simpleString()

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        bars = pdf.sort_values("measure_idx")
        places = bars["measure_idx"].to_list()
        order = play_order([dict.fromkeys(f, True) if f is not None else {} for f in bars["flags"]])
        return pd.DataFrame({"score_id": pdf["score_id"].iloc[0], "play_pos": range(len(order)), "measure_idx": [places[k] for k in order]})

    places = flags.groupBy("score_id").applyInPandas(ordered, f"score_id {kind}, play_pos long, measure_idx long")
    return onsets.join(places, ["score_id", "measure_idx"])
