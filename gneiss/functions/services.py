"""The places where services plug in: text completion and embedding. Nothing here calls a network."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Replies:
    """A stand-in for a completion service: the reply of the first pattern found in the last message."""

    def __init__(self, default: str = ""):
        self.default = default
        self.rules: list[tuple[re.Pattern, str | Callable[[], str]]] = []
        self.asked: list[tuple[str, list[str]]] = []

    def on(self, pattern: str, reply: str | Callable[[], str]) -> Replies:
        self.rules.append((re.compile(pattern), reply))
        return self

    def __call__(self, system: str, messages: list[str]) -> str:
        self.asked.append((system, messages))
        for pattern, reply in self.rules:
            if messages and pattern.search(messages[-1]):
                return reply() if callable(reply) else reply
        return self.default


def embedder(call: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 96) -> Callable[[Column], Column]:
    """A column function from a service that takes lists of texts: Arrow batches in, requests of at most `batch` texts out.

    Every vector has to have `dimension` components. Equal texts of a batch are asked once; null texts give null.
    """

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        asked = list(dict.fromkeys(t for t in texts if t is not None))
        found: dict[str, list[float]] = {}
        for at in range(0, len(asked), batch):
            part = asked[at : at + batch]
            vectors = call(part)
            if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                raise ValueError(f"the service must give {len(part)} vectors of {dimension} components")
            found.update(zip(part, vectors))
        return texts.map(lambda t: found.get(t))

    return run
