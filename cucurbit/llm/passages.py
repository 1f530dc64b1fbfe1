"""Operator 9: near-duplicate passages by compact windows.

Tokens are word shingles.  Under one hash function, the subsequences of a text that have their
least hash at token c are those within a compact window (l, c, r): from behind the nearest
smaller hash on the left to before the nearest on the right, a node of the Cartesian tree over
the text's hashes.  Only windows of ``MIN_WORDS`` words or more matter, some two for each so
many tokens.  Two passages that are alike share the least hash under most of ``HASHES`` functions.

1. The windows of all texts travel by their least hash, as arrays by bucket.  In a group, each
   window meets the one before it, so that copies are linked in a chain and not in all pairs.
   (Texts with the same words are one class and travel once.)  If the two differ in the ``SIDE``
   tokens before or behind the least one, other texts may lie between a window and its partner:
   it then meets the group's first too, and the first and the one before it in the part of the
   group that has the same least token before it, or behind it, under each of ``SKETCH`` other
   functions, as one of the two sides is within the passage: a template's words put thousands of
   texts in one group, and what few of them share tells the copies of one filled-in form apart.
2. For each pair of texts that meet, the intervals that their windows have in common are laid
   over each other; stretches covered under ``ENOUGH`` functions or more are candidates.  A meeting
   in a small part of a large group counts twice, as a second token is shared there.
3. The shingles of both sides of a candidate are fetched and compared: the longest stretches
   with at least ``MIN_WORDS`` words and ``PERCENT`` percent of the union in common are the
   near-duplicate passages.

Pairs, and texts with the stretches wanted of them, are read as sorted streams; no list of either is held.

A passage stays in the text that comes first (by a hash of its words) and goes in the others.

Defined results: null texts have no words; texts shorter than a passage keep all their words.
A passage that one text repeats within itself is no repeat across texts and stays: to cut a text's
refrains is not deduplication of the corpus.
Rows whose words are equal are one class: all but the one with the least id give up all their
words, if they have enough for a passage (rows alike in id and text stay).  White space before a removed passage goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parts, saved
from .kernels import U, Words, mix, powers, slices, sliding_min

SHINGLE = 5
MIN_WORDS = 50
PERCENT = 75
HASHES = 6
ENOUGH = 3
#: Tokens on either side of a window's least one: of a passage's tokens, so many lie on one of its sides.
SIDE = (MIN_WORDS - SHINGLE) // 2
#: Functions under which the least token of a side is a key.
SKETCH = 6
#: A group of half so many windows is large, and a part of it small if it is a pair or a ``LARGE``-th of it.
LARGE = 32
BUCKET_WINDOWS = 150_000
FLUSH = 600_000
#: Sides of a class from which each distinct stretch is fetched once, copies of a stretch that one task makes, and bytes of tokens in a batch.
LISTED = 256
COPIES = 1024
BATCH_BYTES = 16 << 20


def class_of(words: Words) -> np.ndarray:
    """A hash of the sequence of words of each text."""
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))
    own = mix(words.hash ^ mix(place.astype(U)))
    running = np.concatenate([np.zeros(1, U), np.cumsum(own, dtype=U)])
    n = np.diff(words.first).astype(U)
    return mix((running[words.first[1:]] - running[words.first[:-1]]) + mix(n))


def mix32(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(13))


def compact_windows(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of all compact windows of ``width`` or more; ``x`` has a 0 before, between and after the texts."""
    if len(x) < width:
        return (np.zeros(0, np.int64),) * 3
    least = sliding_min(x, width)
    ends = np.zeros(width - 1, x.dtype)
    most = ~sliding_min(~np.concatenate([ends, least, ends]), width)
    c = np.flatnonzero((most == x) & (x > 0) | (x == 0))
    v, idx = x[c], np.arange(len(c))
    # The nearest smaller value of such a place is such a place too.
    left, right = np.maximum(idx - 1, 0), np.minimum(idx + 1, len(c) - 1)
    while (go := (v[left] > v) & (v > 0)).any():
        left = np.where(go, left[left], left)
    while (go := (v[right] >= v) & (v > 0)).any():
        right = np.where(go, right[right], right)
    lo, hi = c[left] + 1, c[right] - 1
    keep = (v > 0) & (hi - lo + 1 >= width)
    return lo[keep], c[keep], hi[keep]


class Sides:
    """Keys of 16 bits for places in ``tokens``: a hash of the SIDE tokens before it and behind it, and the least of either under each function of the sketch; ``tokens`` has zeros between the texts."""

    def __init__(self, tokens: np.ndarray, short: np.ndarray):
        padded = np.concatenate([np.zeros(SIDE, U), tokens, np.zeros(SIDE, U)])
        power, self.inverse = powers(len(padded))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(padded * power[: len(padded)], dtype=U)])
        ends = np.zeros(SIDE, np.uint32)
        around = np.concatenate([ends, short, ends])
        # The tokens are hashes: times an odd number they are in another order.
        self.least = [sliding_min(around * np.uint32(odd), SIDE) for odd in ODD]

    def __call__(self, at: np.ndarray) -> np.ndarray:
        starts = (at, at + SIDE + 1)
        before, behind = (mix((self.sums[i + SIDE] - self.sums[i]) * self.inverse[i]) for i in starts)
        return np.stack([mix(before ^ mix(behind)).astype(np.uint16), *(mix32(least[i], 99).astype(np.uint16) for least in self.least for i in starts)], 1)


KEYS = 1 + 2 * SKETCH
#: The odd numbers of the sketch's functions.
ODD = [(0x9E3779B1 * (2 * k + 1) | 1) & 0xFFFFFFFF for k in range(SKETCH)]


def window_blocks(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Windows by bucket, as arrays: bucket int, sig (32 bits each), own (16 bits each, number among the classes), mids, spans (two of 16 bits: tokens before and behind; what a longer window holds beyond is in others too), keys and classes."""
    names = ["bucket", "sig", "own", "mids", "spans", "keys", "classes"]
    width = MIN_WORDS - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        classes: list[np.ndarray] = []
        n_held = n_classes = 0

        def flush() -> pa.RecordBatch:
            sig, own, mids, spans, keys = (np.concatenate([x[i] for x in held]) for i in range(5))
            cs = np.concatenate(classes)
            bucket, high = (sig & U(0xFFFFFFFF)).astype(np.int64) % buckets, (sig >> U(32)).astype(np.uint32)
            order = np.lexsort((high, bucket))
            bucket, high, own, mids, spans, keys = bucket[order], high[order], own[order], mids[order], spans[order], keys[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows = []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                used, local = np.unique(own[i:j], return_inverse=True)
                rows.append((int(bucket[i]), high[i:j].tobytes(), local.astype(np.uint16).tobytes(), mids[i:j].tobytes(), np.ascontiguousarray(spans[i:j].T).tobytes(), np.ascontiguousarray(keys[i:j].T).tobytes(), cs[used].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names)

        for b in parts(batches):
            for _, data, ends in slices(b.column(0)):
                words = Words(data, ends)
                c = class_of(words)
                h, first = words.shingles(SHINGLE)
                fresh = np.diff(words.first) >= MIN_WORDS
                for i in np.flatnonzero(fresh).tolist():
                    fresh[i] = (key := int(c[i])) not in seen
                    seen.add(key)
                if len(seen) > 200_000:
                    seen = set()
                if not fresh.any():
                    continue
                number = np.cumsum(fresh) - 1
                runs = np.diff(first)
                inside = np.repeat(fresh, runs)
                tokens, count = h[inside], runs[fresh]
                # A zero before each text and one at the end.
                at = np.arange(len(tokens)) + np.repeat(np.arange(len(count)), count) + 1
                base = np.concatenate([[0], np.cumsum(count + 1)])[:-1] + 1
                owner = np.zeros(len(tokens) + len(count) + 1, np.int64)
                owner[at] = np.repeat(number[fresh], count)
                spaced, short, x = (np.zeros(len(owner), t) for t in (U, np.uint32, np.uint32))
                spaced[at] = tokens
                part = (tokens >> U(32)).astype(np.uint32)
                short[at] = part
                sides = Sides(spaced, short)
                for f in range(HASHES):
                    x[at] = mix32(part, f + 1) | np.uint32(1)
                    lo, mid, hi = compact_windows(x, width)
                    own = owner[mid]
                    spans = np.minimum(np.stack([mid - lo, hi - mid], 1), 0xFFFF).astype(np.uint16)
                    # The last three bits tell the function.
                    sig = mix(spaced[mid] ^ mix(np.array([f + 77], U))) >> U(3) << U(3) | U(f)
                    held.append((sig, own + n_classes, (mid - base[own]).astype(np.int32), spans, sides(mid)))
                    n_held += len(mid)
                classes.append(c[fresh])
                n_classes += int(fresh.sum())
                if n_held > FLUSH or n_classes > 60_000:
                    if n_held:
                        yield flush()
                    held, classes, n_held, n_classes = [], [], 0, 0
        if n_held:
            yield flush()

    return docs.select(text).mapInArrow(run, "bucket int, sig binary, own binary, mids binary, spans binary, keys binary, classes binary")


def meetings(blocks: DataFrame, buckets: int) -> DataFrame:
    """Intervals that two windows have in common: a, b (classes, a < b), se (first and last token of b), and fd (the function, plus 8 if the meeting counts twice, and the token of a less that of b); two numbers of 32 bits each."""
    names = ["a", "b", "se", "fd"]

    def one(bucket: int, rows: list[dict]) -> pa.RecordBatch | None:
        sig = np.concatenate([np.frombuffer(r["sig"], np.uint32) for r in rows])
        c = np.concatenate([np.frombuffer(r["classes"], U)[np.frombuffer(r["own"], np.uint16)] for r in rows])
        mid = np.concatenate([np.frombuffer(r["mids"], np.int32) for r in rows]).astype(np.int64)
        spans = np.concatenate([np.frombuffer(r["spans"], np.uint16).reshape(2, -1) for r in rows], 1)
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint16).reshape(KEYS, -1) for r in rows], 1)
        order = np.lexsort((mid, c, sig))
        sig, c, mid, (before, behind), keys = sig[order], c[order], mid[order], spans[:, order].astype(np.int64), keys[:, order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1]) | (mid[1:] != mid[:-1])
        sig, c, mid, before, behind, keys = sig[new], c[new], mid[new], before[new], behind[new], keys[:, new]

        def linked(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of each window and the first of its group, and the last of the class before; ``group`` and the classes in it are sorted."""
            cs, n = c[where], len(group)
            start = np.concatenate([[True], group[1:] != group[:-1]])[:n]
            first = np.flatnonzero(start)[np.cumsum(start) - 1]
            fresh = start | np.concatenate([[True], cs[1:] != cs[:-1]])[:n]
            last = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] - 1
            a, b = np.concatenate([first, last]), np.concatenate([np.arange(n), np.arange(n)])
            keep = np.concatenate([cs[first] != cs, (last > first) & (cs[np.maximum(last, 0)] != cs[first])])
            return where[a[keep]], where[b[keep]]

        where = np.arange(len(sig))
        first, second = linked(sig)
        # A window with the same SIDE tokens on either side as the window of the class before it needs no further partner.
        last = np.zeros(len(sig), np.int64) - 1
        np.maximum.at(last, second, first)
        near = np.flatnonzero(last >= 0)
        settled = np.zeros(len(sig), bool)
        settled[near] = keys[0, near] == keys[0, last[near]]
        keep = ~settled[second] | (first == last[second])
        once = np.zeros(len(sig), bool)
        pairs = [(first[keep], second[keep], once[first[keep]])]
        # Only groups of three windows or more have windows between.
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
        size = np.repeat(np.diff(edge), np.diff(edge))
        several = np.flatnonzero(size > 2)
        for key in keys[1:] if len(several) else ():
            both = sig[several].astype(U) << U(16) | key[several].astype(U)
            by = np.argsort(both, kind="stable")
            both = both[by]
            n = np.diff(np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1], [True]])))
            n = np.repeat(n, n)
            where, both, n = several[by[n > 1]], both[n > 1], n[n > 1]
            small = once.copy()
            small[where] = (2 * size[where] >= LARGE) & (n <= np.maximum(2, size[where] // LARGE))
            first, second = linked(both)
            keep = ~settled[second]
            pairs.append((first[keep], second[keep], small[second[keep]]))
        met = np.unique(np.concatenate([a.astype(U) << U(32) | b.astype(U) << U(1) | x.astype(U) for a, b, x in pairs]))
        # Of equal pairs the marked one is the last.
        last = np.ones(len(met), bool)
        last[:-1] = met[1:] >> U(1) != met[:-1] >> U(1)
        met = met[last]
        a, b, twice = (met >> U(32)).astype(np.int64), (met >> U(1) & U(0x7FFFFFFF)).astype(np.int64), (met & U(1)).astype(np.int64)
        s, e = mid[b] - np.minimum(before[b], before[a]), mid[b] + np.minimum(behind[b], behind[a])
        wide = e - s + 1 >= MIN_WORDS - SHINGLE + 1
        a, b, s, e, twice = a[wide], b[wide], s[wide], e[wide], twice[wide]
        if not len(a):
            return None
        columns = (c[a].view(np.int64), c[b].view(np.int64), s << 32 | e, (bucket % 8 + 8 * twice) << 32 | (mid[a] - mid[b]) & 0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    if (out := one(held[0]["bucket"], held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := one(held[0]["bucket"], held)) is not None:
            yield out

    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long, se long, fd long")


def stretches(f: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at least a passage's tokens that intervals of ``ENOUGH`` functions cover; one marked by 8 counts as two."""
    low, high = int(s.min()), int(e.max()) + 1
    total = np.zeros(high - low, np.int32)
    for own in (*((f & 7) == k for k in np.unique(f & 7)), *(f == k for k in np.unique(f[f >= 8]))):
        d = np.zeros(high - low + 1, np.int32)
        np.add.at(d, s[own] - low, 1)
        np.add.at(d, e[own] + 1 - low, -1)
        total += np.cumsum(d[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], total >= ENOUGH, [False]]).astype(np.int8)))
    return [(low + int(i), low + int(j) - 1) for i, j in zip(edge[::2], edge[1::2], strict=True) if j - i >= MIN_WORDS - SHINGLE + 1]


def candidates(met: DataFrame) -> DataFrame:
    """a, b, and the tokens [sa, ea] of a and [sb, eb] of b that may be alike."""
    names = ["a", "b", "sa", "ea", "sb", "eb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            a, b, se, fd = (batch.column(i).to_numpy() for i in range(4))
            edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
            functions = np.bitwise_count(np.bitwise_or.reduceat(np.int64(1) << (fd >> 32) | np.int64(1) << (fd >> 32 & 7), edge[:-1]))
            out: list[tuple] = []
            for g in np.flatnonzero(functions >= ENOUGH).tolist():
                own = slice(int(edge[g]), int(edge[g + 1]))
                f, s, e, diag = fd[own] >> 32, se[own] >> 32, se[own] & 0xFFFFFFFF, (fd[own] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
                for i, j in stretches(f, s, e):
                    inside = (s <= j) & (e >= i)
                    out.append((int(a[own.start]), int(b[own.start]), max(0, i + int(diag[inside].min())), j + int(diag[inside].max()), i, j))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)], names)

        for batch in batches:
            if not len(batch):
                continue
            # The last pair may go on in the next batch.
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            differ = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            last = int(differ[-1]) + 1 if len(differ) else 0
            if held and (last or (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (a[0], b[0])):
                if (out := told(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0])) is not None:
                    yield out
                held = []
            elif last and (out := told(batch.slice(0, last))) is not None:
                yield out
            held.append(batch.slice(last))
        if held and (out := told(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
            yield out

    return met.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long, sa int, ea int, sb int, eb int")


def best(hit: np.ndarray) -> tuple[int, int]:
    """The stretch [i, j) in which hits most outweigh three times the misses."""
    total = np.concatenate([[0], np.cumsum(np.where(hit, 1, -3))])
    low = np.minimum.accumulate(total)
    j = int(np.argmax(total - low))
    return int(np.argmin(total[: j + 1])), j


def longest(hit: np.ndarray, gain: int, loss: int, least: int) -> tuple[int, int]:
    """The longest stretch [i, j) in which hits times ``gain`` make up for misses times ``loss``, without the misses at its ends that ``least`` can spare."""
    total = np.concatenate([[0], np.cumsum(np.where(hit, gain, -loss))])
    most = np.maximum.accumulate(total[::-1])[::-1]
    # For each start the last end whose sum is not lower; the most that is to come never rises.
    ends = np.searchsorted(-most, -total, "right") - 1
    i = int(np.argmax(ends - np.arange(len(total))))
    j = int(ends[i])
    on = np.flatnonzero(hit[i:j])
    if not len(on):
        return i, i
    start = max(i, min(i + int(on[0]), j - least))
    return start, min(j, max(i + int(on[-1]) + 1, start + least))


def alike(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Stretches of two token sequences that are near-duplicate passages: [i, j) of x and [k, m) of y.

    If both sides are of one length, ``PERCENT`` of the union are hits of 2 P / (100 + P) of a side, at
    the least P percent of a side.  The longest such stretches are tried first, then the densest; where
    none of them passes, a stretch is cut at its longest run of misses, or where its place in x jumps.
    """
    least, out, todo = MIN_WORDS - SHINGLE + 1, [], [(0, len(y))]
    number = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
    x, y = number[: len(x)], number[len(x) :]
    place = np.full(int(number.max()) + 1 if len(number) else 0, -1)
    place[x] = np.arange(len(x))
    rest = 100 - PERCENT

    def tries(hit: np.ndarray) -> list[tuple[int, int]]:
        own = [longest(hit, rest, 2 * PERCENT, least), best(hit), longest(hit, rest, PERCENT, least)]
        return [s for s in dict.fromkeys(own) if s[1] - s[0] >= least]

    def found(p: int, q: int, own: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        for k, m in own:
            k, m = p + k, p + m
            held = np.zeros(len(place), bool)
            held[y[k:m]] = True
            for i, j in tries(held[x]):
                u, v = np.unique(x[i:j]), np.unique(y[k:m])
                shared = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * shared >= PERCENT * (len(u) + len(v) - shared):
                    return i, j, k, m
        return None

    while todo:
        p, q = todo.pop()
        if q - p < least:
            continue
        hit = place[y[p:q]] >= 0
        own = tries(hit)
        if not own:
            continue
        if passage := found(p, q, own):
            out.append(passage)
            todo += [(p, passage[2]), (passage[3], q)]
            continue
        k, m = p + min(s[0] for s in own), p + max(s[1] for s in own)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], hit[k - p : m - p], [True]]).astype(np.int8)))
        if len(edge):
            n = int(np.argmax(edge[1::2] - edge[::2])) * 2
            todo += [(k, k + int(edge[n])), (k + int(edge[n + 1]), m)]
        elif (jump := np.abs(np.diff(place[y[k:m]]) - 1)).any():
            at = k + int(np.argmax(jump)) + 1
            todo += [(k, at), (at, m)]
    return out


def tokens_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: __k (a row's key), pair, side, s, e and once.  The tokens from s to e of that row's text, as bytes: pair, side, s, once and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, ""

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["pair", "side", "s", "once", "tokens"])

        for batch in parts(batches, 1024):
            k, tag = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, asked = [], []
            for i, is_side in enumerate(tag):
                if not is_side:
                    if k[i] != key:
                        key, text = k[i], batch.column(2)[i].as_py()
                elif asked and k[i] == k[asked[-1][-1]]:
                    asked[-1].append(i)
                else:
                    texts.append(text)
                    asked.append([i])
            pair, side, s, e, once = (batch.column(i).to_pylist() for i in range(3, 8))
            out, size = [], 0
            for at, data, ends in slices(pa.array(texts, pa.string())):
                h, first = Words(data, ends).shingles(SHINGLE)
                for n in range(len(ends)):
                    for i in asked[at + n]:
                        out.append((pair[i], side[i], s[i], once[i], h[first[n] + s[i] : min(first[n] + e[i] + 1, first[n + 1])].tobytes()))
                        size += len(out[-1][-1])
                        if size > BATCH_BYTES:
                            yield made()
                            out, size = [], 0
            if out:
                yield made()

    none = F.lit(None)
    texts = rows.select("__k", F.lit(0).alias("tag"), "__text", none.cast("long").alias("pair"), none.cast("int").alias("side"), none.cast("int").alias("s"), none.cast("int").alias("e"), none.cast("boolean").alias("once"))
    sides = wanted.select("__k", F.lit(1).alias("tag"), none.cast("string").alias("__text"), "pair", "side", "s", "e", "once")
    met = texts.unionByName(sides).repartition("__k").sortWithinPartitions("__k", "tag")
    return met.mapInArrow(run, "pair long, side int, s int, once boolean, tokens binary")


def wanted_stretches(sides: DataFrame, one_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sides: __c, pair, side, s, e.  What ``tokens_of`` is to fetch: of classes with few sides each side, and of the others each distinct stretch once, its side then the number of copies to make; and the sides of those with the stretch's number as ``id``, and which copy is theirs."""
    many = F.broadcast(sides.groupBy("__c").agg(F.count("*").alias("__n")).where(f"__n > {LISTED}").select("__c"))
    few = sides.join(many, "__c", "left_anti").join(one_of, "__c").select("__k", "pair", "side", "s", "e", F.lit(False).alias("once"))
    hot = sides.join(many, "__c").withColumn("id", F.xxhash64("__c", "s", "e"))
    each = hot.groupBy("id", "__c", "s", "e").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("copies"))
    once = each.join(one_of, "__c").select("__k", F.col("id").alias("pair"), F.col("copies").alias("side"), "s", "e", F.lit(True).alias("once"))
    often = F.broadcast(each.where("copies > 1").select("id", "copies"))
    salted = hot.select("id", "pair", "side", "s").join(often, "id", "left").withColumn("copy", F.pmod(F.hash("pair", "side"), F.coalesce("copies", F.lit(1))).cast("int"))
    return few.unionByName(once), salted.select("id", "copy", "pair", "side", "s")


def near_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows, saved tables of the rows with their class (key, __k, n_words, __c) and of the classes (__c, __one: its first row, __copies), and the passages: a, b and words [sa, ea) of class a that [sb, eb) of class b repeats."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            n, c = np.zeros(len(b), np.int64), np.zeros(len(b), U)
            for at, data, ends in slices(b.column(1)):
                words = Words(data, ends)
                n[at : at + len(ends)], c[at : at + len(ends)] = np.diff(words.first), class_of(words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(c.view(np.int64))], [key, "__k", "n_words", "__c"])

    kind = docs.schema[key].dataType.simpleString()
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), t.alias("__text"), F.xxhash64(key, t).alias("__k"))
    base = saved(rows.select(key, "__text", "__k").mapInArrow(measure, f"`{key}` {kind}, __k long, n_words long, __c long"))
    total = base.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(16, total * HASHES * 2 // MIN_WORDS // BUCKET_WINDOWS)
    buckets += -buckets % 8  # the bucket then tells the function
    cands = saved(candidates(meetings(window_blocks(docs, text, buckets), buckets)).withColumn("pair", F.xxhash64("a", "b", "sb", "eb")))
    classes = saved(base.groupBy("__c").agg(F.min(F.struct(key, "__k")).alias("__one"), F.count("*").alias("__copies")))
    one_of = classes.select("__c", F.col("__one.__k").alias("__k"))
    sides = cands.select(F.col("a").alias("__c"), "pair", F.lit(0).alias("side"), F.col("sa").alias("s"), F.col("ea").alias("e")).unionByName(cands.select(F.col("b").alias("__c"), "pair", F.lit(1).alias("side"), F.col("sb").alias("s"), F.col("eb").alias("e")))
    wanted, salted = wanted_stretches(sides, one_of)
    fetched = saved(tokens_of(rows, wanted))
    # Of a stretch that many pairs share, the tokens are made once and copied where they are joined.
    copied = fetched.where("once").select(F.col("pair").alias("id"), "tokens", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("copy"))
    got = fetched.where("not once").select("pair", "side", "s", "tokens").unionByName(salted.join(copied, ["id", "copy"]).select("pair", "side", "s", "tokens"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            out = []
            for a, b, sx, sy, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, j, k, m in alike(np.frombuffer(x, U), np.frombuffer(y, U)):
                    out.append((a, b, sx + i, sx + j + SHINGLE - 1, sy + k, sy + m + SHINGLE - 1))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)], ["a", "b", "sa", "ea", "sb", "eb"])

    left, right = (got.where(f"side = {k}").select("pair", F.col("s").alias(f"s{k}"), F.col("tokens").alias(f"tokens{k}")) for k in (0, 1))
    both = left.join(right, "pair").join(cands.select("pair", "a", "b"), "pair")
    found = saved(both.select("a", "b", "s0", "s1", "tokens0", "tokens1").mapInArrow(verify, "a long, b long, sa int, ea int, sb int, eb int"))
    forget(cands, fetched)
    return rows, base, classes, found


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def spans_by_class(found: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """__c, the spans that it gives up as __gone, those that it shares as __shared, and the keys of the rows that keep what it gives up as __sources.

    As b, a class gives its passages up; as a, it keeps them.  A class's spans come as a sorted stream
    and are merged on the way, so a passage that many texts repeat makes no list of them all.
    """
    kind = classes.schema["__one"].dataType[key].dataType.simpleString()
    none = F.lit(None)
    gone = found.select(F.col("b").alias("__c"), F.lit(0).alias("tag"), F.col("sb").alias("s"), F.col("eb").alias("e"), none.cast(kind).alias("id"))
    held = found.select(F.col("a").alias("__c"), F.lit(1).alias("tag"), F.col("sa").alias("s"), F.col("ea").alias("e"), none.cast(kind).alias("id"))
    keepers = found.select(F.col("b").alias("__c"), F.col("a").alias("__o")).distinct().join(classes.select(F.col("__c").alias("__o"), F.col(f"__one.{key}").alias("id")), "__o")
    ids = keepers.select("__c", F.lit(2).alias("tag"), none.cast("int").alias("s"), none.cast("int").alias("e"), "id")
    names = ["__c", "__gone", "__shared", "__sources"]
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lists, said, kind_of = None, ([], []), [], None
        out: list[tuple] = []

        def done() -> None:
            shared = merged([{"s": s, "e": e} for x in lists for s, e in x])
            out.append((own, *([{"s": s, "e": e} for s, e in x] for x in (lists[0], shared)), said or None))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), spans, spans, pa.list_(kind_of)), strict=True)], names)

        for b in parts(batches, 4096):
            kind_of = b.column(4).type
            for c, tag, s, e, i in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != own:
                    if own is not None:
                        done()
                    own, lists, said = c, ([], []), []
                if tag == 2:
                    said.append(i)
                elif lists[tag] and s <= lists[tag][-1][1]:
                    lists[tag][-1] = (lists[tag][-1][0], max(lists[tag][-1][1], e))
                else:
                    lists[tag].append((s, e))
            if len(out) > 1024:
                yield made()
                out = []
        if own is not None:
            done()
            yield made()

    rows = gone.unionByName(held).unionByName(ids).distinct()
    streamed = rows.repartition("__c").sortWithinPartitions("__c", "tag", "s", "e", "id")
    return streamed.mapInArrow(run, f"__c long, __gone array<struct<s:int,e:int>>, __shared array<struct<s:int,e:int>>, __sources array<{kind}>")


def passage_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows with their texts, and for each: key, n_words, n_repeated (words in passages that another row has too), n_removed, n_spans (passages removed), first_ids (the keys of rows that keep them, or that share them with this one), and the word spans removed."""
    rows, base, classes, found = near_passages(docs, key, text)
    # One row a class, saved: a class of many rows can then be split where they are joined.
    by_class = saved(classes.join(spans_by_class(found, classes, key), "__c", "left"))
    forget(found)
    joined = base.join(by_class, "__c")
    copy = (F.col("n_words") >= MIN_WORDS) & (F.col("__copies") > 1) & ((F.col("__k") != F.col("__one.__k")))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e")))
    many = (F.col("n_words") >= MIN_WORDS) & (F.col("__copies") > 1)
    told = joined.select(
        key,
        "__k",
        "n_words",
        F.when(copy, whole).otherwise(F.coalesce("__gone", F.array())).alias("__gone"),
        F.when(many, whole).otherwise(F.coalesce("__shared", F.array())).alias("__all"),
        F.when(copy, F.array(F.col(f"__one.{key}"))).otherwise(F.coalesce("__sources", F.array(F.col(key)).cast(f"array<{docs.schema[key].dataType.simpleString()}>"))).alias("first_ids"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1024):
            out = [[merged(x) for x in b.column(i).to_pylist()] for i in (3, 4)]
            removed = [sum(e - s for s, e in x) for x in out[0]]
            repeated = [sum(e - s for s, e in x) for x in out[1]]
            spans = pa.array([[{"s": s, "e": e} for s, e in x] for x in out[0]], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(repeated, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in out[0]], pa.int64()), b.column(5), spans], [key, "__k", "n_words", "n_repeated", "n_removed", "n_spans", "first_ids", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return rows, told.select(key, "__k", "n_words", "__gone", "__all", "first_ids").mapInArrow(run, f"`{key}` {kind}, __k long, n_words long, n_repeated long, n_removed long, n_spans long, first_ids array<{kind}>, spans array<struct<s:int,e:int>>")


def cut_words(text: str, spans: list) -> str:
    """The text without the words in [s, e) of each span."""
    raw = text.encode("utf-8")
    words = Words(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    kept, at = [], 0
    for x in spans:
        kept.append(raw[at : words.start[x["s"]]].rstrip(b" \t\n\v\f\r"))
        at = int(words.end[x["e"] - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8").strip()


def without_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, each without the passages that it gives up."""
    _, told = passage_report(docs, key, text)
    spans = told.where("n_removed > 0").select("__k", F.col("spans").alias("__spans")).dropDuplicates(["__k"])

    @F.pandas_udf("string")
    def cut(t, s):
        import pandas as pd

        return pd.Series([x if y is None else cut_words(x, y) for x, y in zip(t, s, strict=True)], dtype=object)

    # The row travels as one struct, so that none of its columns meets one of these.
    keyed = docs.select(F.struct("*").alias("__row"), F.xxhash64(key, F.coalesce(F.col(text), F.lit(""))).alias("__k"))
    joined = keyed.join(spans, "__k", "left")
    own = F.col("__row")[text]
    left = F.when(F.col("__spans").isNull(), own).otherwise(cut(own, F.col("__spans")))
    return joined.select(*(left.alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))


def op9_passages(spark, sf_dir: str) -> DataFrame:
    return passage_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1].drop("__k", "spans")
