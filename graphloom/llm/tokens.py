"""Encoding and decoding of whole corpora with a public tokenizer.

The tokenizers library runs over Arrow batches, one call for a batch of texts.  Its token
strings are byte-level: each byte is written as one printable character, so a token may hold
only a part of a character.  ``decode`` reverses that table, joins the bytes of all tokens of
a text and only then reads them as UTF-8, so characters split over tokens come out whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Texts and characters handed to the tokenizer in one call, so that its working set stays small.
CALL_TEXTS, CALL_CHARS = 512, 2_000_000


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per worker.  Strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def calls(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of bounded size; a text is never divided."""
    run: list[str] = []
    chars = 0
    for text in texts:
        run.append(text)
        chars += len(text)
        if len(run) >= CALL_TEXTS or chars >= CALL_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def encode_lists(tokenizer, texts: list[str]) -> Iterator[list[int]]:
    for run in calls(texts):
        for e in tokenizer.encode_batch_fast(run, add_special_tokens=False):
            yield e.ids


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids``, the token ids of ``text``, without special tokens.

    Null and empty texts get an empty list.  Any other column passes through; a column already
    named ``ids`` is replaced.  Repeated rows and ties need no rule: each row depends on its text only.
    """
    path = path or f"{TOKENIZER_DIR}/{BYTE_BPE}"
    keep = [c for c in df.columns if c != ids]
    if text not in keep:
        raise ValueError(f"no column {text}")
    at = keep.index(text)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokenizer = load(path)
        for batch in batches:
            texts = batch.column(at).fill_null("").to_pylist()
            parts, lengths = [], np.zeros(len(texts) + 1, np.int32)
            for i, x in enumerate(encode_lists(tokenizer, texts)):
                parts.append(np.array(x, np.int32))
                lengths[i + 1] = len(x)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*keep, ids])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str = "text", size: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``key`` and the number of tokens of ``text``; 0 for null and empty texts."""
    path = path or f"{TOKENIZER_DIR}/{BYTE_BPE}"
    schema = T.StructType([df.schema[key], T.StructField(size, T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            sizes = [len(x) for x in encode_lists(tokenizer, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[key, size])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def offsets(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Add ``tokens``: id, first and last character position (end exclusive) of each token.

    Positions are code points of the text.  Tokens that share one character, because its bytes
    were split, all name that character.  Null and empty texts get an empty list.
    """
    path = path or f"{TOKENIZER_DIR}/{BYTE_BPE}"
    keep = [c for c in df.columns if c != "tokens"]
    at = keep.index(text)
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "start", "end")]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("tokens", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        arrow = pa.list_(pa.struct([(n, pa.int32()) for n in ("id", "start", "end")]))
        for batch in batches:
            rows = []
            for part in calls(batch.column(at).fill_null("").to_pylist()):
                for e in tokenizer.encode_batch(part, add_special_tokens=False):
                    rows.append([{"id": i, "start": a, "end": b} for i, (a, b) in zip(e.ids, e.offsets)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*keep, "tokens"])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def byte_characters() -> dict[str, int]:
    """Printable character of each byte in token strings, by the published rule.

    Printable Latin-1 bytes stand for themselves; the others follow from code point 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    table = byte_characters()
    return {i: bytes(table[c] for c in s) if all(c in table for c in s) else s.encode() for s, i in load(path).get_vocab().items()}


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of the token ids; null for null, empty for an empty list.

    Bytes that are no UTF-8, as after cutting a list of ids inside a character, become U+FFFD.
    """
    path = path or f"{TOKENIZER_DIR}/{BYTE_BPE}"
    keep = [c for c in df.columns if c != text]
    at = keep.index(ids)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            out = [None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*keep, text])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
