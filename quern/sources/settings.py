"""Settings as one JSON document: defaults, then what is stored, then what is supplied, checked as a whole."""

from __future__ import annotations

import json
import os

#: The ranges of whole numbers, both ends included, and the choices of words.
RANGES = {
    "portNumber": (1, 65535),
    "workerConcurrency": (1, 64),
    "numCentroids": (1, 100000),
    "subVectorsPQ": (1, 1024),
    "chunkSize": (1, 100000),
    "chunkOverlap": (0, 99),
    "keepAliveSeconds": (0, 86400),
    "topKCandidates": (1, 1000),
    "topNRerank": (1, 1000),
    "rateLimitMax": (1, 100000),
    "maxPayloadMB": (1, 2048),
}
CHOICES = {"distanceMetric": ["Cosine", "L2", "Dot"], "indexAlgorithm": ["IVF-PQ", "FLAT"]}
TOKEN = "apiToken"


def check(settings: dict) -> dict:
    """The settings, if each is allowed; a bool isn't a number."""
    bad = [k for k, (low, high) in RANGES.items() if type(settings.get(k)) is not int or not low <= settings[k] <= high]
    bad += [k for k, allowed in CHOICES.items() if settings.get(k) not in allowed]
    if bad:
        raise ValueError(f"invalid settings: {', '.join(bad)}")
    return settings


class Settings:
    """The document at a path on the driver. The token is kept but never shown, and an empty one doesn't clear it."""

    def __init__(self, path: str, defaults: dict):
        self.path, self.defaults = path, defaults

    def stored(self) -> dict:
        """What is stored over the defaults; only the defaults if the document can't be read."""
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            found = {}
        return self.defaults | (found if isinstance(found, dict) else {})

    def show(self) -> dict:
        return self.stored() | {TOKEN: ""}

    def update(self, **supplied: object) -> dict:
        """Check and write the whole document, at once, and show it."""
        before = self.stored()
        after = check(before | supplied)
        after[TOKEN] = supplied.get(TOKEN) or before.get(TOKEN) or ""
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(after, f)
        os.replace(f"{self.path}.new", self.path)
        return self.show()
