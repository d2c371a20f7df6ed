"""A bounded state that follows observable events: decay to a baseline, then a fixed change by kind of event."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Baseline, bounds and changes by kind.
BASELINE = {"valence": 0.0, "arousal": 0.0, "confidence": 0.5, "stress": 0.0}
LOWEST = {"valence": -1.0, "arousal": 0.0, "confidence": 0.0, "stress": 0.0}
CHANGES = {
    "memory": {"valence": 0.06, "arousal": 0.02, "confidence": 0.08, "stress": -0.04},
    "web": {"valence": 0.06, "arousal": 0.02, "confidence": 0.08, "stress": -0.04},
    "parametric": {"arousal": 0.01, "confidence": -0.06, "stress": 0.03},
    "no_evidence": {"arousal": 0.01, "confidence": -0.02, "stress": 0.02},
}
DECAY = 0.2


def step(state: dict[str, float], kind: str, decay: float = DECAY) -> dict[str, float]:
    """The state after one event; an identity event puts it back to the baseline."""
    if kind == "identity":
        return dict(BASELINE)
    change = CHANGES.get(kind, {})
    moved = {k: v + (BASELINE[k] - v) * decay + change.get(k, 0.0) for k, v in state.items()}
    return {k: min(1.0, max(LOWEST[k], v)) for k, v in moved.items()}


def label(s: dict[str, float]) -> str:
    if s["stress"] >= 0.45:
        return "stressed"
    if s["valence"] <= -0.05:
        return "negative"
    if s["valence"] >= 0.05:
        return "positive"
    return "uncertain" if s["confidence"] <= 0.45 else "neutral"


def fold(events: DataFrame, key: str) -> DataFrame:
    """key, updates, the four values and the label after all events (key, at, kind) of each key, in order.

    Each event depends on the one before, so a key's events go to one call; long histories are folded in a stream (see
    streaming.affect), which keeps the state instead.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = dict(BASELINE)
        for e in rows.sort_values(["at", "event_id"])["kind"]:
            s = step(s, e)
        return pd.DataFrame([{key: k[0], "updates": len(rows), **{n: round(v, 6) for n, v in s.items()}, "label": label(s)}])

    return events.groupBy(key).applyInPandas(run, f"{key} {kind}, updates long, valence double, arousal double, confidence double, stress double, label string")
