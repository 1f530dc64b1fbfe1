"""Operator 5: token counts by batch encoding in Arrow functions that return lengths only.

Long texts are split at safe boundaries, the pieces are put in batches of about equal bytes, and
each batch goes through the tokenizer library in one call.  No ids leave the worker.

A boundary is safe where a blank or line end follows another sign, and before a mark of CJK
punctuation behind a letter or digit: the vocabulary's pattern ends a word there in any context,
as none of its words goes on with a blank or, from a letter or digit, with a mark; and no special
string holds either.  A text without such a place stays whole.

Defined results: a null text counts as an empty one, with no bytes and no tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import parts

PIECE_CHARS = 16_384
BATCH_BYTES = 1_000_000
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[^\W_])(?=[。、，！？；：])")

_tokenizers: dict = {}


def tokenizer(path: str):
    """One for each Python worker, without threads of its own, truncation or padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _tokenizers[path] = own
    return _tokenizers[path]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of the text whose tokens together are those of the text."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def count_batch(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """The number of tokens of each text."""
    own, counts = tokenizer(path), [0] * len(texts)
    held, whose, size = [], [], 0

    def flush() -> None:
        for i, e in zip(whose, own.encode_batch_fast(held, add_special_tokens=False), strict=True):
            counts[i] += len(e)

    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append(piece)
            whose.append(i)
            size += len(piece) if piece.isascii() else len(piece.encode("utf-8"))
            if size >= batch_bytes:
                flush()
                held, whose, size = [], [], 0
    if held:
        flush()
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and whether there are more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2048):
            texts = pc.fill_null(b.column(1), "")
            size = pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            n = pa.array(count_batch(texts.to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
