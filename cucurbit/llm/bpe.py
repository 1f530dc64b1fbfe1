"""Operator 4: byte-pair encoding and decoding with a contiguous rank array.

Every short word holds the ids of its parts in one contiguous row and the rank of each
adjacent pair in another.  The row's least rank is found by a scan, the boundary behind it is
deleted, and only the two neighbouring ranks are looked up again, until no pair has a rank.
The words that an Arrow batch has and the worker's word table lacks are encoded together: one
numpy row a word, so that a scan is an ``argmin`` over all of them.  Words of more than
``LONG_WORD`` symbols would make the scans quadratic and take a heap of ranks instead, with the
same result.

Defined results: a null text is an empty text; it and a text of white space only have no
tokens.  Special strings inside a text become their special ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

LONG_WORD = 48
#: Strings between white space that a worker keeps with their ids; reaching it empties the table.
CACHED_CHUNKS = 500_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8_000_000
NO_RANK = np.int32(2**31 - 1)
#: Stands between the ids of two strings.
END = NO_RANK.astype("<u4").tobytes()


class WordBpe:
    """The vocabulary of a tokenizer file with word-end suffixes, and a table of words met so far."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        (pattern,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.joined = regex.compile(pattern + r"|\n").findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.size = np.int64(size)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        self.ids: dict[str, bytes] = {}

    # -- words -> ids -------------------------------------------------------------------------

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.key_rank[at], NO_RANK)

    def encode_rows(self, parts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """parts: one word a row, padded with -1; it is changed in place.  Returns the lengths left."""
        width = parts.shape[1]
        if width == 1:
            return length
        rank = self.rank_of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
        live = np.arange(len(parts))
        columns = np.arange(width)
        while len(live):
            own = rank[live]
            at = own.argmin(1)
            least = own[np.arange(len(live)), at]
            going = least != NO_RANK
            live, at, least = live[going], at[going], least[going]
            if not len(live):
                break
            p = parts[live]
            shifted = np.concatenate([p[:, 1:], np.full((len(p), 1), -1, np.int32)], 1)
            p = np.where(columns > at[:, None], shifted, p)
            p[np.arange(len(p)), at] = self.merged[least]
            r = own[going]
            shifted = np.concatenate([r[:, 1:], np.full((len(r), 1), NO_RANK, np.int32)], 1)
            r = np.where(columns[:-1] > at[:, None], shifted, r)
            rows = np.arange(len(p))
            after = np.minimum(at + 1, width - 1)
            right = np.where(at + 1 < width, p[rows, after], -1)
            before = np.maximum(at - 1, 0)
            left = np.where(at > 0, p[rows, before], -1)
            here = np.minimum(at, width - 2)
            fresh = self.rank_of(p[rows, at], right)
            r[rows, here] = np.where(at < width - 1, fresh, r[rows, here])
            r[rows, before] = np.where(at > 0, self.rank_of(left, p[rows, at]), r[rows, before])
            parts[live], rank[live] = p, r
            length[live] -= 1
        return length

    def encode_long(self, parts: list[int]) -> list[int]:
        """A heap of (rank, place) over a linked list, for words on which repeated scans would be quadratic."""
        n, size, ranks = len(parts), int(self.size), self.ranks
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := ranks.get(parts[i] * size + parts[k])) is not None:
                    heapq.heappush(heap, (s, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (s := ranks.get(parts[h] * size + parts[i])) is not None:
                heapq.heappush(heap, (s, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers."""
        out = {w: np.array([i], "<u4").tobytes() for w, i in self.specials.items()}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w not in out and w != "\n":
                raw = w.encode("utf-8", "replace")
                by_length.setdefault(len(raw) if len(raw) <= LONG_WORD else 0, []).append((w, raw))
        for n, group in by_length.items():
            if n == 0:
                for w, raw in group:
                    symbols = self.inner[np.frombuffer(raw, np.uint8)]
                    symbols[-1] = self.last[raw[-1]]
                    out[w] = np.array(self.encode_long(symbols.tolist()), "<u4").tobytes()
                continue
            raw = np.frombuffer(b"".join(r for _, r in group), np.uint8).reshape(-1, n)
            parts = self.inner[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            length = self.encode_rows(parts, np.full(len(group), n))
            rows = np.ascontiguousarray(parts.astype("<u4")).tobytes()
            for i, ((w, _), k) in enumerate(zip(group, length.tolist(), strict=True)):
                out[w] = rows[4 * n * i : 4 * (n * i + k)]
        return out

    # -- texts --------------------------------------------------------------------------------

    def split(self, chunk: str) -> list[str]:
        """The words of a string; special strings stay whole."""
        if "<|" not in chunk:
            return self.words(normal(chunk))
        out: list[str] = []
        for i, piece in enumerate(self.special.split(chunk)):
            out += [piece] if i % 2 else self.words(normal(piece))
        return out

    def learn(self, chunks: list[str]) -> None:
        """Puts strings without ASCII white space in the table: no word crosses white space."""
        if len(self.ids) + len(chunks) > CACHED_CHUNKS:
            self.ids.clear()
        plain = [c for c in chunks if "<|" not in c]
        words = self.joined(normal("\n".join(plain))) if plain else []
        if words.count("\n") != len(plain) - 1:  # a letter became a line end or was lost
            plain, words = [], []
        done = set(plain)
        odd = [] if len(plain) == len(chunks) else [c for c in chunks if c not in done]
        split = [self.split(c) for c in odd]
        known = self.word_ids(list(set(words).union(*split))) | {"\n": END}
        flat = b"".join(map(known.__getitem__, words))
        ends = np.append(np.flatnonzero(np.frombuffer(flat, "<u4") == NO_RANK) * 4, len(flat))
        starts = np.concatenate([[0], ends[:-1] + 4])
        self.ids.update(zip(plain, [flat[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], strict=False))
        self.ids.update((c, b"".join([known[w] for w in own])) for c, own in zip(odd, split, strict=True))

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """For slices of the texts: the code of each string between white space as a list column, and by code the ids of these strings as bytes."""
        for piece in slices(texts):
            lists = pc.ascii_split_whitespace(piece)
            coded = lists.flatten().dictionary_encode()
            # By way of numpy, as to_pylist makes a scalar of each.
            chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids: list[bytes] = []
            for at in range(0, len(chunks), CACHED_CHUNKS // 2):
                own = chunks[at : at + CACHED_CHUNKS // 2]
                if missing := [c for c in own if c not in self.ids]:
                    if len(self.ids) + len(missing) > CACHED_CHUNKS:
                        missing = own
                    self.learn(missing)
                ids += map(self.ids.__getitem__, own)
            yield lists.offsets, coded.indices, pa.array(ids, pa.binary())

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        for offsets, codes, ids in self.encode_column(texts):
            yield from pc.binary_join(pa.ListArray.from_arrays(offsets, ids.take(codes)), b"").to_pylist()

    def encode_decode(self, texts: pa.Array) -> Iterator[tuple[bytes, str]]:
        """Ids and the text that they stand for."""
        for offsets, codes, ids in self.encode_column(texts):
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.take(codes)), b"")
            said = pa.array([self.decode(i) for i in ids.to_numpy(zero_copy_only=False).tolist()], pa.string())
            full = pc.greater(pc.binary_length(ids), 0).take(codes).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(before[offsets.to_numpy()]), said.take(codes.filter(pa.array(full))))
            yield from zip(joined.to_pylist(), pc.binary_join(lists, " ").to_pylist(), strict=True)

    def encode(self, text: str) -> bytes:
        return next(self.encode_many(pa.array([text])))

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with spaces between, as a tokenizer file without a decoder has them."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def normal(text: str) -> str:
    """NFC and lower case letter by letter (a capital sigma is never a final one)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """One for each Python worker."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of some ``SLICE_BYTES``; nulls become empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield texts[at:to]
        at = to


def bpe_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of its ids and digests of its ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in parts(batches, 2048):
            n, ids_sha, text_sha = [], [], []
            for ids, decoded in own.encode_decode(b.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """Adds the ids of each text as an array of int."""

    @F.pandas_udf("array<int>")
    def ids(s):
        return pd.Series([np.frombuffer(i, "<u4").astype(np.int32) for i in model(path).encode_many(pa.array(s, pa.string()))])

    return docs.withColumn(to, ids(F.coalesce(F.col(text), F.lit(""))))


def bpe_decode(docs: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the text that an array of ids stands for; a null array gives an empty text."""

    @F.pandas_udf("string")
    def text(s):
        own = model(path)
        return s.map(lambda a: "" if a is None else own.decode(np.asarray(a, "<u4").tobytes()))

    return docs.withColumn(to, text(F.col(ids)))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
