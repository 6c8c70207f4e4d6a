"""Embedders: what turns texts into vectors, called in batches by the tasks, and null wherever it fails."""

from __future__ import annotations

import json
import logging
import math
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

log = logging.getLogger(__name__)

#: Vectors of a batch of texts, null for those that have none. It is sent to the tasks, so it must be picklable.
Embedder = Callable[[list[str]], Sequence[Sequence[float] | None]]


def http_embedder(url: str, model: str, timeout: float = 30.0) -> Embedder:
    """A service that takes {"model", "prompt"} and gives {"embedding"}, one text a call; any failure of a call is a null."""

    def run(texts: list[str]) -> list[Sequence[float] | None]:
        out: list[Sequence[float] | None] = []
        for text in texts:
            ask = urllib.request.Request(url, json.dumps({"model": model, "prompt": text}).encode(), {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(ask, timeout=timeout) as answer:
                    out.append(json.load(answer).get("embedding"))
            except (OSError, ValueError, AttributeError):
                log.warning("a text has no embedding", exc_info=True)
                out.append(None)
        return out

    return run


def letters(texts: list[str]) -> list[list[float]]:
    """How often each letter of a to z occurs, in either case: a stand-in that needs no service."""
    return [[float(t.count(chr(c)) + t.count(chr(c - 32))) for c in range(97, 123)] for t in texts]


def _vector(v) -> list[float] | None:
    """A vector if it has a number in each place and is not empty."""
    try:
        out = [float(x) for x in v]
    except (TypeError, ValueError):
        return None
    return out if out and all(map(math.isfinite, out)) else None


class Bounded:
    """An embedder with a deadline for each batch. After ``patience`` batches in a row that fail it is taken for dead, and not called again."""

    def __init__(self, embedder: Embedder, deadline: float, patience: int = 3) -> None:
        self.embedder, self.deadline, self.left, self.patience = embedder, deadline, patience, patience
        self.pool = ThreadPoolExecutor(1)

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        if not self.left or not texts:
            return [None] * len(texts)
        try:
            got = list(self.pool.submit(self.embedder, texts).result(self.deadline))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors of {len(texts)} texts")
            self.left = self.patience
            return [_vector(v) for v in got]
        except Exception:  # whatever an embedder does, its texts have no vector and all rows stay
            log.warning("a batch has no embeddings", exc_info=True)
            self.left -= 1
            self.pool.shutdown(wait=False, cancel_futures=True)
            self.pool = ThreadPoolExecutor(1)  # the old thread may still hang
            return [None] * len(texts)


def embed(rows: DataFrame, embedder: Embedder, batch: int = 64, deadline: float = 30.0, text_col: str = "text") -> DataFrame:
    """``rows`` with ``vector`` (array<float>) in place of the text; null where the text is null or the embedder fails.

    A task sends ``batch`` texts a call and waits ``deadline`` seconds for
    each. A call that raises, is late, or gives another number of vectors
    costs only its own texts their vectors; vectors that are empty or hold
    anything but finite numbers are null. No row is lost.
    """
    kept = [c for c in rows.columns if c != text_col]
    out = rows.select(*kept).withColumn("vector", F.lit(None).cast("array<float>")).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Bounded(embedder, deadline)
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                texts = part.column(len(kept)).to_pylist()
                vectors = iter(ask([t for t in texts if t is not None]))
                found = [None if t is None else next(vectors) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, arrow.field("vector").type)], schema=arrow)

    return rows.select(*kept, text_col).mapInArrow(run, out)
