"""Encoding of a whole corpus with a public tokenizer (problem 7)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank files of the public tokenizers lie; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are encoded at once; longer texts are cut at safe boundaries.
PIECE = 100_000

_encoders: dict[int, object] = {}


def rank_file(path: str | None = None) -> bytes:
    """The bytes of a rank file. They are read on the driver and travel with the task (under 1 MB), so workers need no copy."""
    with open(path or os.path.join(TOKENIZERS, BYTE_BPE), "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tiktoken encoding of a rank file; built once per worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text where no token can reach across: before an ASCII space or line feed that follows an ASCII letter or digit.

    The pattern starts a new match at every change from a word to white space, and a match never looks back, so
    the pieces encode to the same ids as the whole. A stretch without such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text):
            if text[cut] in " \n" and text[cut - 1].isascii() and text[cut - 1].isalnum():
                break
            cut += 1
        yield text[start:cut]
        start = cut
    if start < len(text):
        yield text[start:]


def encode_text(enc, text: str | None, size: int = PIECE) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, size) for i in enc.encode_ordinary(piece)]


def _readable(raw: bytes | None) -> str:
    return raw.decode("utf-8", errors="replace") if raw else ""


def encode(docs: DataFrame, keys: list[str], text: str = "text", ranks: bytes | None = None, counts_only: bool = False, size: int = PIECE) -> DataFrame:
    """Add to ``keys`` the ids of each text without special tokens (``ids``), or only their number (``tokens``).

    Null and empty texts have an empty list. Strings that look like special tokens are ordinary text. Bytes that
    are no UTF-8 are read as the replacement character. Every row is encoded by itself, in Arrow batches, without
    a shuffle; texts travel as bytes and are decoded once.
    """
    ranks = ranks if ranks is not None else rank_file()
    src = docs.select(*keys, F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            made = [encode_text(enc, _readable(x.as_py()), size) for x in batch.column(len(keys))]
            col = pa.array([len(x) for x in made], pa.int64()) if counts_only else pa.array(made, pa.list_(pa.int32()))
            yield from whole.select(keys).append_column("tokens" if counts_only else "ids", col).to_batches()

    head = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, head + (", tokens long" if counts_only else ", ids array<int>"))


def decode(encoded: DataFrame, keys: list[str], ids: str = "ids", ranks: bytes | None = None) -> DataFrame:
    """The raw bytes of each list of ids joined and read as UTF-8: (keys, text). An empty list gives an empty text, null gives null."""
    ranks = ranks if ranks is not None else rank_file()
    src = encoded.select(*keys, F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", errors="replace") for x in batch.column(len(keys)).to_pylist()]
            yield from pa.Table.from_batches([batch]).select(keys).append_column("text", pa.array(texts, pa.string())).to_batches()

    head = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, head + ", text string")
