"""Deterministic stand-ins for models, simple enough to restate in SQL."""

from __future__ import annotations

import numpy as np


def letter_encoder():
    """Four counts per text: characters, blanks, letters e and letters a."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array(
            [[len(t), t.count(" "), t.count("e"), t.count("a")] for t in texts], dtype=np.float32
        ).reshape(-1, 4)

    return encode


def vowel_classifier():
    """POSITIVE, Neutral or negative by whether e, neither or a is more frequent."""

    def classify(texts: list[str]) -> list[dict]:
        found = []
        for t in texts:
            e, a = t.count("e"), t.count("a")
            label = "POSITIVE" if e > a else "negative" if a > e else "Neutral"
            found.append({"label": label, "score": max(e, a) / (e + a) if e + a else 0.5})
        return found

    return classify
