"""Models that turn texts into vectors: a registry of providers, and encoding whose vectors are checked and of length 1."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import facade

#: Characters of a text that a model reads.
MOST_CHARS = 6000
Encode = Callable[[list[str]], np.ndarray]
#: For each provider a function of a model's name that loads the model, on the executor that needs it.
PROVIDERS: dict[str, Callable[[str], Encode]] = {}


def register(provider: str, load: Callable[[str], Encode]) -> None:
    PROVIDERS[provider] = load


def can_embed(provider: str, model: str, dim: int) -> bool:
    """Hashed words always can; a registered provider if its model loads and gives vectors of dim numbers."""
    if provider == "hash":
        return True
    try:
        return np.asarray(PROVIDERS[provider](model)([""])).shape == (1, dim)
    except Exception:  # noqa: BLE001  whatever keeps a foreign model from loading, it can't embed
        return False


def checked(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, zero vectors as they are; one that is not a number is an error."""
    bad = int(np.isnan(vectors).any(axis=1).sum())
    if bad:
        raise ValueError(f"{bad} of {len(vectors)} vectors are not numbers")
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths == 0, 1.0, lengths)


def embed(texts: DataFrame, provider: str, model: str, dim: int) -> DataFrame:
    """id, v of texts (id, text). A task loads the model once and encodes batch by batch; a null text counts as empty.

    Hashed words need no model and stay in the engine.
    """
    if provider == "hash":
        return facade.hashed(texts.select("id", F.coalesce("text", F.lit("")).alias("text")), dim)
    load = PROVIDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for b in batches:
            if len(b):
                encode = encode or load(model)
                vectors = np.asarray(encode([(t or "")[:MOST_CHARS] for t in b["text"]]), np.float64).reshape(len(b), -1)
                if vectors.shape[1] != dim:
                    raise ValueError(f"{provider}:{model} gives {vectors.shape[1]} numbers, not {dim}")
                yield pd.DataFrame({"id": b["id"], "v": list(checked(vectors))})

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, v array<double>")
