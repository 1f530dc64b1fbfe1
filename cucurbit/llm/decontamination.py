"""Operator 13: benchmark decontamination by one Aho-Corasick automaton.

Test items (questions and answers) become windows of ``WINDOW`` consecutive normalised words; an
item of fewer words, but not none, is one window.  All windows are the keys of one automaton over
word numbers.  Each text is normalised once, its words are replaced by the numbers that the items'
words have (0 for all others, from which no edge leads on), and the automaton reads them once; it
reports each window that ends at a word, whatever overlaps.  Words covered by a window are hit, and
runs of hit words are mapped back to places in the original text.

The items' windows are sent to all tasks, so their size is counted first: up to ``BLOCK_WORDS``
words of windows are one automaton.  A larger benchmark goes in blocks, one after the other: a
block's pass adds its spans to those that the rows carry already, and the rows are saved in between.
Nothing is shuffled, and a text's time doesn't depend on how many windows it holds beyond the words
that they cover.

Defined results: a null or empty text, or one without words, has no words and no hits; a null or
wordless item is nowhere.  Rows of the benchmark with one item_id are one item with several texts;
an item without an id marks words, but is not named.  Repeated documents are scanned as they come,
null doc_ids stay null.  Columns of the documents named n_words, spans, n_hit or items are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, saved

WINDOW = 10
#: Words of windows in one automaton; each is some 100 bytes of a worker's memory, measured.
BLOCK_WORDS = 2_000_000
ADDED = {"n_words": "long", "spans": "array<struct<start:long,stop:long,words:long>>", "n_hit": "long", "items": "array<long>"}

#: What is no word of lower-cased UTF-8 becomes a space: all but digits, letters and bytes from 128 on.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item (null for one without an id) and key, the words joined by spaces, of each distinct window."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = items.select(F.col(item_id).cast("long").alias("item"), F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return split.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("key")).distinct()


class Matcher:
    """One automaton over the windows of a block.

    A word's number is its place among the block's words, from 1 on.  It goes in as two symbols, of
    ranges of their own, so that no node has more edges than the root of the number of words: the
    automaton looks through a node's edges one by one.
    """

    def __init__(self, rows: list[tuple[int | None, str]]):
        import ahocorasick

        by_window: dict[str, set] = defaultdict(set)
        for item, key in rows:
            by_window[key].add(item)
        split = [key.encode("utf-8").split(b" ") for key in by_window]
        vocabulary = dict.fromkeys(w for ws in split for w in ws)
        self.base = int(len(vocabulary) ** 0.5) + 1
        self.symbols = {w: (n // self.base, self.base + n % self.base) for n, w in enumerate(vocabulary, 1)}
        self.sizes = [len(ws) for ws in split]
        self.items = [frozenset(v) - {None} for v in by_window.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, ws in enumerate(split):
            self.automaton.add_word(self.sequence(ws), n)
        self.automaton.make_automaton()

    def sequence(self, ws: list[bytes]) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.symbols.get, ws, repeat((0, self.base)))))

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Numbers of the hit words, ascending, and the items found."""
        found = list(self.automaton.iter(self.sequence(ws))) if self.sizes else []
        if not found:
            return np.zeros(0, np.int64), set()
        last, size = np.array([e for e, _ in found]) // 2 + 1, np.array([self.sizes[k] for _, k in found])
        edge = np.bincount(last - size, minlength=len(ws) + 1) - np.bincount(last, minlength=len(ws) + 1)
        return np.flatnonzero(np.cumsum(edge) > 0), set().union(*(self.items[k] for k in {k for _, k in found}))


def places(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as places in the text, in characters: start, stop (behind the last) and their words."""
    plain = np.frombuffer(text.translate(NORMAL), np.uint8)
    inside = np.concatenate([[False], plain != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    return [{"start": int(a), "stop": int(b), "words": int(n)} for a, b, n in zip(chars[starts[first]], chars[stops[last]], last - first + 1, strict=True)]


def hit_words(text: bytes, spans: list[dict]) -> np.ndarray:
    """Numbers of the words in spans made by ``places``."""
    if not spans:
        return np.zeros(0, np.int64)
    plain = np.frombuffer(text.translate(NORMAL), np.uint8)
    inside = np.concatenate([[False], plain != 32])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[starts]
    firsts = np.searchsorted(chars, [s["start"] for s in spans])
    return np.concatenate([np.arange(f, f + s["words"]) for f, s in zip(firsts, spans, strict=True)])


def _pass(docs: DataFrame, block: list, text: str) -> DataFrame:
    """Adds a block's hits to what the rows carry."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in parts(batches, 256):
            own = b.columns[: len(b.columns) - 4]
            n_words, spans, n_hit, items = [], [], [], []
            before = zip(b.columns[-3].to_pylist(), b.columns[-1].to_pylist(), strict=True)
            for t, (marked, known) in zip(pc.fill_null(b.columns[at].cast(pa.large_binary()), b""), before, strict=True):
                t = t.as_py()
                ws = words(t)
                hit, found = matcher.scan(ws)
                if marked:
                    hit = np.union1d(hit, hit_words(t, marked))
                n_words.append(len(ws))
                n_hit.append(len(hit))
                spans.append(places(t, hit) if len(hit) else [])
                items.append(sorted(found.union(known)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))
            made = [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, *made], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, spans (places of hit words in the text), n_hit and items (found, ascending)."""
    keys = windows(items, item_id, item_text, size)
    total = keys.count() * size
    # Hashes deal windows out evenly, but not quite.
    n = 1 if total <= block_words else -(-5 * total // (4 * block_words))
    if n > 1:
        keys = saved(keys)
    empty = {name: F.lit(0) if kind == "long" else F.array() for name, kind in ADDED.items()}
    rows = docs.drop(*ADDED).select("*", *(v.cast(ADDED[k]).alias(k) for k, v in empty.items()))
    for k in range(n):
        block = keys if n == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k)
        rows = _pass(rows if k == 0 else saved(rows), [(r.item, r.key) for r in block.toLocalIterator()], text)
    return rows


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle_sql() -> str:
    """DuckDB's SQL for the query."""
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents),
i AS (SELECT item_id, {split} AS w FROM benchmark),
keys AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS key
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM keys),
places AS (
  SELECT k, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS key
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT places.k, places.s, places.n, keys.item_id FROM places JOIN keys USING (n, key)),
hits AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT k, s, n FROM met)) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT k, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (k) LEFT JOIN named USING (k)"""
