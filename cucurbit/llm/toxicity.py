"""Operator 1: noisy-channel deobfuscation before toxicity scoring.

1. A character language model: trigram counts over the letters of every text, summed by Spark.
   It has at most ``len(LETTERS) + 2`` cubed entries, so the table that workers get is bounded.
2. A string of any length with a sign that is used for a letter, a separator within, a repeated
   character or letters set apart becomes a lattice: each character may stand for itself, for the
   letters it is used for, or for nothing if it repeats or separates.  Viterbi decoding over all
   states finds the likeliest string under the model.
3. A classifier over words and character 5-grams of the restored text, from how many labelled
   training texts of either kind have them.  At most about ``SAMPLE`` labelled rows are used, which
   bounds the features too; near copies of a training text count once.
4. A text's score combines the weights of all its words by a noisy-or.

Labels come only from rows whose crc32(id as text) mod 3 isn't 1.  Language, source and id are
no inputs of a score.

Defined results: null and empty texts score 0; without labels every score is 0.  Several labels
of one id count as the highest; null labels count as none.  A null id is held out never.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts

THRESHOLD = 0.7
#: Labelled rows that the classifier is fitted on, at most about.
SAMPLE = 20_000
#: Training texts of label 1 that a feature needs.
LEAST_TEXTS = 5
GRAM = 5

#: The letters that the language model tells apart; others are one class.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüßœ"
#: The letters that a sign may be written for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~/'"
CLASSES = len(LETTERS) + 2
SPACE, OTHER = 0, len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": SPACE}
#: What a step through the lattice costs, in nats.
COST_LEET, COST_DROPPED_REPEAT, COST_DROPPED_SEPARATOR, COST_KEPT_SIGN = 1.0, 2.0, 1.2, 6.0
CACHED = 200_000

EDGES = re.compile(r"^[^\w@$€£]+|[^\w]+$")
#: Signs at the ends that stand for no letter.
OUTER = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$")
DISGUISED = re.compile(r"(.)\1|[013456789@$!|+(€£]|.[.\-_*~/'].", re.DOTALL)


# -- the language model ---------------------------------------------------------------------------


def _class_table() -> np.ndarray:
    table = np.full(0x250, OTHER, np.uint8)
    for c, i in CODE.items():
        if ord(c) < len(table):
            table[ord(c)] = i
    for c in "\t\n\v\f\r":
        table[ord(c)] = SPACE
    return table


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of class trigrams over all texts: trigram int, n long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _class_table(), np.zeros(CLASSES**3, np.int64)
        for b in parts(batches, 128):
            texts = pc.fill_null(b.column(0), "").to_pylist()
            points = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
            c = table[np.minimum(points, len(table) - 1)].astype(np.int32)
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["trigram", "n"])

    return docs.select(text).mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: list[tuple[int, int]]) -> np.ndarray:
    """log P(c | a, b) as classes x classes x classes, interpolated with lower orders."""
    three = np.zeros(CLASSES**3)
    for i, n in counts:
        three[i] = n
    three = three.reshape((CLASSES,) * 3)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 5 * p1) / (two.sum(-1, keepdims=True) + 5)
    return np.log((three + 5 * p2) / (three.sum(-1, keepdims=True) + 5))


# -- decoding ---------------------------------------------------------------------------------------


def restore(disguised: str, model: np.ndarray) -> str:
    """The likeliest string that was written in this disguise."""
    return best_path(disguised, model)[1]


def best_path(disguised: str, model: np.ndarray) -> tuple[float, str]:
    """The log probability of the likeliest path through the lattice, less the costs of its steps, and the string it spells."""
    # A path is its last letter and the path before, so that long strings are not copied at each step.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(SPACE, SPACE): (0.0, None)}
    before = ""
    for c in disguised.lower():
        steps: list[tuple[str, float]] = []
        if c in SEPARATORS:
            steps += [("", COST_DROPPED_SEPARATOR), (" ", 0.0)]
        elif c in CODE:
            steps.append((c, 0.0))
        else:
            steps.append((c, COST_KEPT_SIGN if c in LEET else 0.0))
        steps += [(x, COST_LEET) for x in LEET.get(c, "")]
        if c == before:
            steps.append(("", COST_DROPPED_REPEAT))
        found: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, out) in paths.items():
            for said, cost in steps:
                if said:
                    k = CODE.get(said, OTHER)
                    state, value, path = (b, k), score - cost + model[a, b, k], (said, out)
                else:
                    state, value, path = (a, b), score - cost, out
                if state not in found or found[state][0] < value:
                    found[state] = (value, path)
        paths = found
        before = c
    score, last = max(((score + model[a, b, SPACE], path) for (a, b), (score, path) in paths.items()), key=lambda x: x[0], default=(0, None))
    letters = []
    while last:
        letters.append(last[0])
        last = last[1]
    return score, "".join(reversed(letters)).strip()


# -- words of a text ----------------------------------------------------------------------------------


def restored_words(chunk: str, model: np.ndarray) -> list[str]:
    """The plain words that a string between white space may stand for; the string as written is the first."""
    chunk = chunk.lower()
    word, outer = EDGES.sub("", chunk), OUTER.sub("", chunk)
    found = [word] if word else []
    for own in dict.fromkeys((word, outer)):
        if own and DISGUISED.search(own):
            found += restore(own, model).split()
    return found


def features(word: str) -> set[str]:
    held = f"^{word}$"
    return {held, *(held[i : i + GRAM] for i in range(len(held) - GRAM + 1))}


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """List offsets, codes of the strings between white space, and the strings by code."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    c = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy(), c.indices.to_numpy(), c.dictionary.to_numpy(zero_copy_only=False).tolist()


def set_apart(offsets: np.ndarray, codes: np.ndarray, chunks: list[str]) -> Iterator[tuple[int, str]]:
    """Runs of three or more single letters, whatever stands around them: the text's number and the letters with spaces between."""
    bare = [c if len(c) == 1 or len(c) > 6 else OUTER.sub("", c) for c in chunks]
    single = np.array([len(c) == 1 and not c.isspace() for c in bare], bool)[codes] if len(chunks) else np.zeros(0, bool)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not single.any():
        return
    change = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        for i in range(a, b):  # a run may go from one text to the next
            if i == a or own[i] != own[i - 1]:
                run = [i]
                while run[-1] + 1 < b and own[run[-1] + 1] == own[i]:
                    run.append(run[-1] + 1)
                if len(run) >= 3:
                    yield int(own[i]), " ".join(bare[codes[j]] for j in run)


# -- the classifier -----------------------------------------------------------------------------------


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """text and toxic of at most about ``sample`` labelled rows, one of each group of near copies."""
    own = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max("toxic").alias("__toxic"))
    own = own.where(~held_out("__key"))
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("__key"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(own), "__key")
    words = F.split(F.lower("__text"), r"\s+")
    least = [F.array_min(F.transform(words, lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in (1, 2)]
    firsts = rows.select("__key", F.hash(*least).alias("__near")).groupBy("__near").agg(F.min("__key").alias("__key")).select("__key")
    return rows.join(F.broadcast(firsts), "__key").dropDuplicates(["__key"]).select(F.col("__text").alias("text"), F.col("__toxic").cast("int").alias("toxic"))


def feature_counts(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """feature, texts of label 1 and of label 0 that have it; a row of feature '' counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            names = list(counts[1] | counts[0])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))], ["feature", "toxic", "clean"])

        counts = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                offsets, codes, chunks = coded(pa.array([t], pa.string()))
                words = {w for c in chunks for w in restored_words(c, model)}
                words.update(w for _, s in set_apart(offsets, codes, chunks) for w in restore(s, model).split())
                counts[1 if y else 0].update(set().union({""}, *map(features, words)))
                if len(counts[0]) > 500_000:
                    yield out()
                    counts = (Counter(), Counter())
        yield out()

    return rows.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from 0 to 1 by feature: how surely a text with it is of label 1.

    Kept are features whose share of label 1 is above one half by the lower end of Wilson's interval.
    """
    t, n, z = F.col("toxic"), F.col("toxic") + F.col("clean"), 2.0
    low = (t / n + z * z / (2 * n) - z * F.sqrt((t / n * (1 - t / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    kept = feature_counts(training_rows(docs, labels, key, text, sample), model).where((F.col("feature") != "") & (t >= LEAST_TEXTS)).select("feature", low.alias("low"), "toxic")
    # All of them: features of LEAST_TEXTS texts or more of a bounded sample.
    return {r.feature: min(0.95, 1.6 * (r.low - 0.45)) for r in kept.where("low > 0.5").collect()}


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """held_out, score and predicted of every document, with the key or the columns to keep; those must not have these three names."""
    model = log_probabilities([(r.trigram, r.n) for r in letter_counts(docs, text).collect()])
    weights = fit(docs, labels, model, key, text, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model, own_weights = shared.value
        cache: dict[str, float] = {}

        def word_weight(w: str) -> float:
            if (whole := own_weights.get(held := f"^{w}$")) is not None:
                return whole
            return max((own_weights.get(held[i : i + GRAM], 0.0) for i in range(len(held) - GRAM + 1)), default=0.0)

        def weight(chunk: str) -> float:
            return max(map(word_weight, restored_words(chunk, own_model)), default=0.0)

        for b in parts(batches, 1024):
            texts, scores = pc.fill_null(b.column(b.schema.get_field_index(text)), ""), []
            for at in range(0, len(texts), 1024):
                offsets, codes, chunks = coded(texts[at : at + 1024])
                if len(cache) > CACHED:
                    cache = {}
                each = np.zeros(len(chunks))
                for i, c in enumerate(chunks):
                    if (x := cache.get(c)) is None:
                        x = cache[c] = weight(c)
                    each[i] = x
                left = np.concatenate([[0.0], np.cumsum(np.log1p(-each[codes]))])
                logs = left[offsets[1:]] - left[offsets[:-1]]
                for k, s in set_apart(offsets, codes, chunks):
                    logs[k] += sum(math.log1p(-word_weight(w)) for w in restore(s, own_model).split())
                scores.append(-np.expm1(np.minimum(logs, 0)))
            scores = np.round(np.concatenate(scores), 9) + 0.0 if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], b.column(b.schema.get_field_index("held_out")), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], [*kept, "held_out", "score", "predicted"])

    kept = keep or [key]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    # The text travels once, with the columns to keep or beside them.
    return docs.select(*kept, *([] if text in kept else [text]), held_out(key).alias("held_out")).mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
