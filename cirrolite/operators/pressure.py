"""Load bands with hysteresis and the health of keys. Each depends on the samples of its key before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Enter and exit thresholds.
ENTER = {"SuperHot": 100_000.0, "Hot": 50_000.0, "Warm": 10_000.0}
EXIT = {"SuperHot": 80_000.0, "Hot": 40_000.0, "Warm": 8_000.0}
RANK = {"Cold": 0, "Normal": 1, "Warm": 2, "Hot": 3, "SuperHot": 4}


def next_band(score: float, previous: str, scale: float = 1.0, cold: float = 0.0) -> str:
    for band in ("SuperHot", "Hot", "Warm"):
        if score >= ENTER[band] * scale or RANK[previous] >= RANK[band] and score >= EXIT[band] * scale:
            return band
    return "Cold" if score <= cold else "Normal"


def hysteresis(samples: DataFrame, key: str, seq: str, score: str, scale: float = 1.0, cold: float = 0.0) -> DataFrame:
    """Adds band to each sample.

    Whether a key is at a level or above it depends on that level's thresholds alone: the last sample that reached the enter threshold or fell below the
    exit threshold decides. So the bands are three window functions, and no state runs through Python.
    """
    by = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(score)
    at = {b: F.last(F.when(x >= ENTER[b] * scale, True).when(x < EXIT[b] * scale, False), ignorenulls=True).over(by) for b in ENTER}
    return samples.withColumn("band", F.when(at["SuperHot"], "SuperHot").when(at["Hot"], "Hot").when(at["Warm"], "Warm").when(x <= cold, "Cold").otherwise("Normal"))


def evaluate(state: dict, seq: int, observed: str, band: str, pressure: float, cooling: int = 3, ttl: int = 64, change: float = 0.25) -> str | None:
    """One step of a key's health; returns the reason of a transition. state: status, start, baseline, cool."""

    def to(status: str, start: int | None, baseline: float | None, reason: str) -> str:
        state.update(status=status, start=start, baseline=baseline, cool=0 if status != "RetryEligible" else state["cool"])
        return reason

    if state["status"] == "RetryEligible":
        return to("Quarantined", seq, pressure, "ReenteredQuarantine") if observed == "Quarantined" else to(observed, None, None, "ClearedByEffectiveRelief")
    if state["status"] == "Quarantined":
        state["cool"] = state["cool"] + 1 if band in ("Cold", "Normal") else 0
        if state["cool"] >= cooling:
            return to("None", None, None, "ClearedBySustainedCooling")
        if seq - state["start"] >= ttl:
            return to("RetryEligible", state["start"], state["baseline"], "MarkedRetryEligibleByTtl")
        if abs(pressure - state["baseline"]) / max(state["baseline"], 1.0) >= change:
            return to("RetryEligible", state["start"], state["baseline"], "MarkedRetryEligibleByPressureChange")
        return None
    if observed == "Quarantined":
        return to("Quarantined", seq, pressure, "EnteredQuarantine")
    state.update(status=observed, start=None, baseline=None, cool=0)
    return None


def health(samples: DataFrame, key: str, seq: str) -> DataFrame:
    """The transitions of each key. samples: key, seq, observed, band, pressure."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        state, rows = {"status": "None", "start": None, "baseline": None, "cool": 0}, []
        for r in frame.sort_values(seq).itertuples():
            was, start = state["status"], state["start"]
            if reason := evaluate(state, getattr(r, seq), r.observed, r.band, r.pressure):
                rows.append((getattr(r, key), getattr(r, seq), was, state["status"], reason, getattr(r, seq) - start if start is not None else 0))
        return pd.DataFrame(rows, columns=[key, seq, "before", "after", "reason", "age"])

    return samples.groupBy(key).applyInPandas(one, f"{key} bigint, {seq} bigint, before string, after string, reason string, age bigint")


def outcomes(moves: DataFrame, key: str, seq: str, least: float = 0.25, limit: int = 2) -> DataFrame:
    """Adds ineffective (in a row, so far) and observed: relief below `least` of what was expected is ineffective, `limit` of them quarantine."""
    by = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("actual") < F.col("expected") * least
    rows = moves.withColumn("island", F.count_if(~bad).over(by))
    run = F.count_if(bad).over(Window.partitionBy(key, "island").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("ineffective", run).drop("island").withColumn("observed", F.when(F.col("ineffective") >= limit, "Quarantined").otherwise("MovableHot"))
