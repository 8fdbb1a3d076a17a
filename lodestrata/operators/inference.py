"""Model inference as a table function: image rows in, records out.

A provider stands for the models. It is built once in each Python worker, from a factory that is
sent along, and maps one image to its record; images whose bytes cannot be read become skipped
records and never stop a task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import stem
from ..functions.records import RECORD


class Unreadable(ValueError):
    """The image cannot be decoded."""


class Provider(Protocol):
    def segment(self, name: str, content: bytes) -> dict:
        """A record of the image: file_name, status, width, height, qa, instances."""


class Embedder(Protocol):
    def embed(self, contents: list[bytes]) -> list[list[float]]:
        """A vector for each image."""


def segment(images: DataFrame, factory: Callable[[], Provider]) -> DataFrame:
    """Records of (file_name, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            out = []
            for name, content in zip(b.file_name, b.content, strict=True):
                try:
                    record = model.segment(name, bytes(content))
                except Unreadable as e:
                    record = {"status": "skipped", "reason": f"unreadable: {e}"}
                out.append(json.dumps({**record, "file_name": name}))
            yield pd.DataFrame({"line": out})

    lines = images.select("file_name", "content").mapInPandas(run, "line string")
    return lines.select(F.from_json("line", RECORD).alias("r")).select("r.*")


def embeddings(images: DataFrame, factory: Callable[[], Embedder], batch: int = 16) -> DataFrame:
    """(file_name, embedding), in small batches as a model wants them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({"file_name": part.file_name, "embedding": model.embed([bytes(x) for x in part.content])})

    return images.select("file_name", "content").mapInPandas(run, "file_name string, embedding array<float>")


def unique_stems(names: DataFrame, name: str = "file_name") -> DataFrame:
    """Stems that more than one file of a folder would share as outputs."""
    return names.groupBy(stem(F.col(name)).alias("stem")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names")).where("n > 1")
