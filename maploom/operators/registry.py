"""Named encoders, tools and loaders that a user can add to."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENCODERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}
TOOLS: dict[str, tuple[Callable[..., DataFrame], dict[str, type]]] = {}


def register_encoder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """``load()`` runs once a worker and gives the function from texts to vectors."""
    ENCODERS[name] = load


def _hashing() -> Callable[[list[str]], np.ndarray]:
    def encode_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 64))
        for i, text in enumerate(texts):
            for token in re.findall(r"[^\W_]+", text.lower()):
                h = zlib.crc32(token.encode())
                out[i, h % 64] += 1.0 if h >> 31 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return encode_texts


register_encoder("hashing", _hashing)


def encode(name: str, text: Column) -> Column:
    """Vectors of a text column by a registered encoder, in Arrow batches."""
    if name not in ENCODERS:
        raise KeyError(f"no encoder {name!r}")
    load = ENCODERS[name]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for s in batches:
            yield pd.Series(list(encoder(s.fillna("").tolist())))

    return run(text)


def register_tool(name: str, fn: Callable[..., DataFrame], arguments: dict[str, type]) -> None:
    TOOLS[name] = (fn, arguments)


def call_tool(name: str, arguments: dict) -> DataFrame:
    """Run a tool by name; unknown tools, and missing, unknown or mistyped arguments are errors."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}")
    fn, wanted = TOOLS[name]
    if set(wanted) != set(arguments):
        raise ValueError(f"{name} takes {sorted(wanted)}, not {sorted(arguments)}")
    for key, kind in wanted.items():
        if not isinstance(arguments[key], kind):
            raise TypeError(f"{name}: {key} must be {kind.__name__}")
    return fn(**arguments)
