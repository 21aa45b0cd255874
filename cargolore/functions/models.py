"""Models as columns.

A model has a name, a version and a way to load it.  It is loaded once in each Python
worker, at its first batch, and kept there for later tasks of the worker; texts come
in Arrow batches.  ``versions`` feeds the version stamp of a screening.

Embedding models have ``encode(texts) -> array (texts, dimensions)``; their vectors are
scaled to length one, and a text that is null or empty gives zeros.  Pair models have
``score(pairs) -> logits``; a null counts as an empty text.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@dataclass(frozen=True)
class Model:
    """``load`` is sent to the executors by value; it may read files that they all reach."""

    name: str
    version: str
    load: Callable[[], Any]
    #: Put before texts on the query side, and there only.
    query_prefix: str = ""


def loaded(model: Model) -> Any:
    """The model of this worker.  It is kept in a module of its own, as functions that
    are sent by value bring their globals anew with each task."""
    kept = sys.modules.setdefault("_cargolore_models", types.ModuleType("_cargolore_models")).__dict__
    key = (model.name, model.version)
    if key not in kept:
        kept[key] = model.load()
    return kept[key]


def embedder(model: Model, *, query: bool = False) -> Callable[[Column], Column]:
    """A text column's vectors; ``query`` says that it is the query side."""
    prefix = model.query_prefix if query else ""

    @F.pandas_udf(ArrayType(DoubleType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = loaded(model)
        for texts in batches:
            some = texts.fillna("").str.strip() != ""
            v = np.asarray(own.encode([prefix + t for t in texts[some]]), float) if some.any() else None
            width = v.shape[1] if v is not None else len(own.encode([""])[0])
            out = np.zeros((len(texts), width))
            if v is not None:
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                out[some.to_numpy()] = v / np.where(norm > 0, norm, 1.0)
            yield pd.Series(list(out))

    return lambda text: vectors(text)


def pair_scorer(model: Model) -> Callable[[Column, Column], Column]:
    """A pair scorer; it runs in Python, so it cannot stand inside a lambda function
    (``vectorised`` says so to those that would put it there)."""

    @F.pandas_udf(DoubleType())
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = loaded(model)
        for one, two in batches:
            yield pd.Series(np.asarray(own.score(list(zip(one.fillna(""), two.fillna(""), strict=True))), float))

    def scorer(one: Column, two: Column) -> Column:
        return logits(one, two)

    scorer.vectorised = True
    return scorer


class Registry:
    """Models by name, one version of each."""

    def __init__(self, *models: Model) -> None:
        self._models: dict[str, Model] = {}
        for model in models:
            self.add(model)

    def add(self, model: Model) -> None:
        """A name's later version takes the place of the one before."""
        self._models[model.name] = model

    def __getitem__(self, name: str) -> Model:
        if name not in self._models:
            raise KeyError(f"no model {name!r} among {sorted(self._models)}")
        return self._models[name]

    def versions(self) -> dict[str, str]:
        """Artifacts for :func:`cargolore.operators.screen.version_stamp`."""
        return {f"model.{n}": m.version for n, m in sorted(self._models.items())}
