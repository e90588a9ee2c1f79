"""Vectors as corpus files hold them: base64 of a little-endian 4-byte scale and one signed byte per component."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

HEADER = 4


def read_vector(text: str | None) -> np.ndarray | None:
    """The vector of a payload or of a plain JSON array of numbers; null stays null, anything else is an error."""
    if text is None:
        return None
    if text.lstrip().startswith("["):
        return np.array([float(x) for x in json.loads(text)], dtype=np.float32)
    raw = base64.b64decode(text, validate=True)
    if len(raw) <= HEADER:
        raise ValueError("encoded vector is too short to contain a scale and any components")
    return np.frombuffer(raw, dtype=np.int8, offset=HEADER).astype(np.float32) * np.frombuffer(raw, dtype="<f4", count=1)[0]


def write_vector(vector: np.ndarray | None) -> str | None:
    """The payload of a vector; a zero vector has scale 0."""
    if vector is None:
        return None
    v = np.asarray(vector, dtype=np.float32)
    largest = np.max(np.abs(v), initial=np.float32(0))
    scale = np.float32(largest / np.float32(127))
    steps = np.clip(np.rint(v / scale), -127, 127) if scale > 0 else np.zeros(len(v))
    return base64.b64encode(np.array([scale], dtype="<f4").tobytes() + steps.astype(np.int8).tobytes()).decode("ascii")


@F.pandas_udf(ArrayType(FloatType()))
def decoded(text: pd.Series) -> pd.Series:
    return text.map(read_vector, na_action="ignore")


@F.pandas_udf(StringType())
def encoded(vector: pd.Series) -> pd.Series:
    return vector.map(write_vector, na_action="ignore")
