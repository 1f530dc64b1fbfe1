"""Operator 3: an exact self-join of word-shingle sets by Jaccard similarity, with pigeonholes over a partition of the universe.

Texts with equal sets form one class; what follows is on classes.

* Sets are in bands by size, doubling.  A band cuts the universe of shingle hashes into ``m``
  segments.  If two sets differ in at most H shingles, at least ``m - H`` of their segments are
  equal.  A set thus needs only ``H + 1`` of its segments in the index: it leaves out the empty
  ones first and then the ones that cost most (in how many texts of a sample their rarest shingle
  is), in an order that all sets share, so that an equal segment of two linked sets stays in both.
* Small sets have few segments; there the index holds each segment and its one-deletion
  neighbourhood, so that a segment may differ by one shingle and half as many segments do.
* A set with too many empty segments for that count also takes part under the next seed of the
  partition, up to ``SEEDS``; what is left then is indexed by each of its shingles.
* A set also takes part in the band below if a set there can be large enough to be linked.

Signatures travel as sorted arrays by bucket, six bytes each.  Candidates whose sketches (the
parities of the shingles in so many cells) differ in more places than linked sets may differ in
shingles go without a look at the texts, which loses none; the others are verified on the texts'
own shingles.

1. Each member of a signature's group meets the group's first; that links most of a group of
   near copies in one go, with as many pairs as members.
2. In groups that still hold several components, all pairs of different components are held
   against each other, sketch by sketch, inside the tasks: a group is dealt in tiles of two
   blocks of members, and only the pairs that pass come out.  Pairs within a component need no look.

Defined results: null and wordless texts have an empty set and no links; fewer words than a
shingle make one shingle.  Rows with equal ids are rows of their own.  A row without an id is linked
like any other, and its component is named by the least id there is in it, or by null.  Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parts, saved
from .components import components
from .kernels import U, Words, mix, slices

SHINGLE = 5
#: Percent of the union that the intersection must have.
PERCENT = 75
#: Largest size of bands with one-deletion neighbourhoods.
SMALL = 32
SLACK = 0.3
SEEDS = 6
#: Documents of the sample for frequent shingles, the share of them that makes one frequent, and the most that are kept.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 16_000, 0.0004, 60_000
BUCKET_SIGNATURES = 400_000
#: Bytes of a bucket that a task holds; a bucket beyond it, which a frequent signature makes, is grouped row by row.
HELD = 256 << 20
FLUSH = 800_000
#: Members of a group in one side of a tile, words of sketches that are compared at a time, and groups of a class that its rows list.
BLOCK, AT_ONCE, LISTED = 2048, 1 << 21, 4


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the texts: number of the first, distinct sorted shingle hashes of each text one after the other, and text numbers."""
    for at, data, ends in slices(texts):
        hashes, first = Words(data, ends).shingles(n)
        whose = np.repeat(np.arange(len(ends)), np.diff(first))
        order = np.lexsort((hashes, whose))
        h, w = hashes[order], whose[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        yield at, h[new], w[new]


def totals(values: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """Sums by text modulo 2**64; ``whose`` is sorted."""
    running = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    edge = np.searchsorted(whose, np.arange(n + 1))
    return running[edge[1:]] - running[edge[:-1]]


def class_ids(h: np.ndarray, whose: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a hash of the set of each text."""
    size = np.bincount(whose, minlength=n)
    return size, mix(totals(mix(h), whose, n) ^ mix(totals(mix(h ^ U(0xA5A5A5A5)), whose, n) + size.astype(U)))


# -- signatures ---------------------------------------------------------------------------------------


def most_different(size: np.ndarray, top: np.ndarray | int, percent: int) -> np.ndarray:
    """In how many shingles a linked pair may differ, if one has ``size`` and the smaller at most ``top``."""
    # A partner of size s and the smaller l share percent / (100 + percent) of s + l at least, and s is at most 100 l / percent.
    largest = np.where(size <= top, size * 100 // percent, top)
    return (size + largest) * (100 - percent) // (100 + percent)


def segments_of(high: int, percent: int) -> int:
    """Of the band whose largest size is ``high``."""
    most = int(most_different(np.array([high]), high, percent)[0])
    return (most + 2) // 2 if high <= SMALL else int((most + 1) * (1 + SLACK)) + 1


def band_signatures(h: np.ndarray, whose: np.ndarray, size: np.ndarray, high: int, seed: int, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and their text numbers of texts taking part in one band, and the numbers of those that need another seed."""
    m = segments_of(high, percent)
    tag = mix(np.array([high * 64 + seed], U))[0]
    segment = (mix(h ^ tag) >> U(33)).astype(np.int64) % m
    order = np.lexsort((segment, whose))
    w, s, token = whose[order], segment[order], mix(h[order] + tag)
    start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])]))
    count = np.diff(np.append(start, len(w)))
    content = np.add.reduceat(token, start)
    texts, own = w[start], s[start].astype(U)
    need = most_different(size, high, percent) + 1
    n = len(size)

    def sign(c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return mix(c ^ mix(k * U(0x9E3779B97F4A7C15) + tag))

    if high <= SMALL:
        usable = np.bincount(texts[count >= 2], minlength=n)
        present = np.bincount(texts, minlength=n) > 0
        failed = np.flatnonzero(present & (2 * usable < need))
        at = np.repeat(np.arange(len(start)), count)
        fewer = count[at] > 1
        sigs = np.concatenate([sign(content, own), sign(content[at] - token, own[at])[fewer]])
        return sigs, np.concatenate([texts, w[fewer]]), failed
    filled = np.bincount(texts, minlength=n)
    failed = np.flatnonzero((filled > 0) & (filled < need))
    sigs = sign(content, own)
    cost = np.zeros(len(start), np.int64)
    shingles, texts_with = frequent
    if len(shingles):
        own_order = h[order]
        at = np.minimum(np.searchsorted(shingles, own_order), len(shingles) - 1)
        cost = np.minimum.reduceat(np.where(shingles[at] == own_order, texts_with[at], 0), start)
    order = np.lexsort((sigs, -cost, texts))
    first = np.searchsorted(texts[order], np.arange(n))
    place = np.arange(len(order)) - first[texts[order]]
    spare = np.where(filled < need, 0, filled - need)
    keep = order[place >= spare[texts[order]]]
    return sigs[keep], texts[keep], failed


def signatures(h: np.ndarray, whose: np.ndarray, size: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of some texts, and the number of the text of each."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    high = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    high = np.maximum(high, 4)
    lower = high // 2
    below = (lower >= 4) & (size * percent <= lower * 100)
    for role, takes in ((high, size * (100 - percent) >= percent), (lower, below)):
        for b in np.unique(role[takes]).tolist():
            live = takes & (role == b)
            for seed in range(SEEDS + 1):
                inside = live[whose]
                if not inside.any():
                    break
                if seed == SEEDS:  # a linked pair shares a shingle
                    out.append((mix(h[inside] + U(b)), whose[inside]))
                    break
                sigs, texts, failed = band_signatures(h[inside], whose[inside], np.where(live, size, 0), b, seed, frequent, percent)
                out.append((sigs, texts))
                live = np.zeros(len(size), bool)
                live[failed] = True
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def signature_blocks(docs: DataFrame, text: str, buckets: int, frequent: tuple[np.ndarray, np.ndarray], percent: int, n: int) -> DataFrame:
    """Signatures by bucket, as arrays: bucket int, sig (32 bits each), own (16 bits each, number among the classes), classes and sizes."""
    names = ["bucket", "sig", "own", "classes", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        classes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n_held = n_classes = 0

        def flush() -> pa.RecordBatch:
            sig, own = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            cs, ns = np.concatenate(classes), np.concatenate(sizes)
            bucket = (sig & U(0xFFFFFFFF)).astype(np.int64) % buckets
            high = (sig >> U(32)).astype(np.uint32)
            order = np.lexsort((high, bucket))
            bucket, high, own = bucket[order], high[order], own[order].astype(np.uint32)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows = []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                used, local = np.unique(own[i:j], return_inverse=True)
                rows.append((int(bucket[i]), high[i:j].tobytes(), local.astype(np.uint16).tobytes(), cs[used].tobytes(), ns[used].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names)

        for b in parts(batches):
            for _, h, whose in shingle_sets(b.column(0), n):
                count = int(whose[-1]) + 1 if len(whose) else 0
                size, c = class_ids(h, whose, count)
                fresh = np.zeros(count, bool)
                for i, x in enumerate(c.tolist()):
                    if size[i] and x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 200_000:  # copies further apart are only sent again
                    seen = set()
                inside = fresh[whose]
                if not inside.any():
                    continue
                number = np.cumsum(fresh) - 1
                sig, own = signatures(h[inside], number[whose[inside]], size[fresh], frequent, percent)
                held.append((sig, own + n_classes))
                classes.append(c[fresh])
                sizes.append(size[fresh])
                n_held, n_classes = n_held + len(sig), n_classes + int(fresh.sum())
                if n_held > FLUSH or n_classes > 60_000:
                    if n_held:
                        yield flush()
                    held, classes, sizes, n_held, n_classes = [], [], [], 0, 0
        if n_held:
            yield flush()

    return docs.select(text).mapInArrow(run, "bucket int, sig binary, own binary, classes binary, sizes binary")


def bucket_groups(blocks: DataFrame, buckets: int, held_bytes: int) -> DataFrame:
    """What ``groups`` returns; of buckets above ``held_bytes`` all signatures, with many -1.

    Classes that share a signature with another: g (the signature), c, n (size), many (size of the group), and the group's first class and its size."""
    names = ["g", "c", "n", "many", "c0", "n0"]

    def one(bucket: int, rows: list[dict]) -> pa.RecordBatch | None:
        sig = np.concatenate([np.frombuffer(r["sig"], np.uint32) for r in rows])
        c = np.concatenate([np.frombuffer(r["classes"], U)[np.frombuffer(r["own"], np.uint16)] for r in rows])
        n = np.concatenate([np.frombuffer(r["sizes"], np.uint32)[np.frombuffer(r["own"], np.uint16)] for r in rows])
        order = np.lexsort((c, sig))
        sig, c, n = sig[order], c[order], n[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
        sig, c, n = sig[new], c[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.diff(np.append(first, len(sig)))
        start, many = np.repeat(first, many), np.repeat(many, many)
        keep = many > 1
        if not keep.any():
            return None
        g = (sig[keep].astype(np.int64) << 31) ^ bucket
        columns = (g, c[keep].view(np.int64), n[keep].astype(np.int32), many[keep].astype(np.int32), c[start][keep].view(np.int64), n[start][keep].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def plain(row: dict) -> pa.RecordBatch:
        own = np.frombuffer(row["own"], np.uint16)
        c, n = np.frombuffer(row["classes"], U)[own].view(np.int64), np.frombuffer(row["sizes"], np.uint32)[own].astype(np.int32)
        g = (np.frombuffer(row["sig"], np.uint32).astype(np.int64) << 31) ^ row["bucket"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g, c, n, np.full(len(g), -1, np.int32), c, n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        bucket, size = None, 0
        for b in parts(batches, 64):
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    if held and (out := one(bucket, held)) is not None:
                        yield out
                    held, bucket, size = [], row["bucket"], 0
                size += len(row["sig"]) + len(row["own"]) + len(row["classes"]) + len(row["sizes"])
                held.append(row)
                if size > held_bytes:
                    yield from map(plain, held)
                    held = []
        if held and (out := one(bucket, held)) is not None:
            yield out

    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "g long, c long, n int, many int, c0 long, n0 int")


def groups(blocks: DataFrame, buckets: int, held_bytes: int = HELD) -> DataFrame:
    """Classes that share a signature with another: g (the signature), c, n (size), many (size of the group), and the group's first class and its size; a saved table."""
    found = saved(bucket_groups(blocks, buckets, held_bytes))
    large = found.where("many < 0").select("g", "c", "n")
    if large.isEmpty():
        return found
    large = large.distinct()
    told = large.groupBy("g").agg(F.count("*").cast("int").alias("many"), F.min(F.struct("c", "n")).alias("first")).where("many > 1")
    counted = large.join(told, "g").select("g", "c", "n", "many", F.col("first.c").alias("c0"), F.col("first.n").alias("n0"))
    both = saved(found.where("many > 0").unionByName(counted))
    forget(found)
    return both


def frequent_shingles(docs: DataFrame, text: str, n_docs: int, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least ``FREQUENT`` of a bounded sample of texts have, in order, and how many have them: an order of cost, no filter."""
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, _ in shingle_sets(b.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64(text, F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else docs
    least = max(6, int(FREQUENT * min(SAMPLE_DOCS, n_docs)))
    rows = sample.select(text).mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least)
    top = rows.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()
    h, n_texts = np.array([r.h for r in top], np.int64).view(U), np.array([r[1] for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n_texts[order]


# -- verification -------------------------------------------------------------------------------------


def sketch(h: np.ndarray) -> bytes:
    """Whether each of 2 to 4 cells a shingle, 256 at least, holds an odd number of them.  A power of two, so that a longer sketch folds to a shorter one."""
    cells = max(256, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & U(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """c, size of the set and sketch of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for at, h, whose in shingle_sets(b.column(1), n):
                edge = np.searchsorted(whose, np.arange(int(whose[-1]) + 2)) if len(whose) else np.zeros(1, np.int64)
                cells = [sketch(h[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(cells)], pa.array(np.diff(edge), pa.int32()), pa.array(cells, pa.binary())], ["c", "size", "cells"])

    return texts.select("c", "text").mapInArrow(run, "c long, size int, cells binary")


def plausible(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose sketches don't show that they differ in too many shingles."""
    sides = [cells.select(F.col("c").alias(k), F.col("size").alias(f"size_{k}"), F.col("cells").alias(f"cells_{k}")) for k in ("u", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1024):
            keep = []
            for n, m, x, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                if len(y) > len(x):
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (n + m) * (100 - percent))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sides[0], "u").join(sides[1], "v")
    return both.select("u", "v", "size_u", "size_v", "cells_u", "cells_v").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs of classes u, v whose shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("c").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("c").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            total = len(batch)
            sets: list[list[np.ndarray]] = []
            for k in (2, 3):
                own: list[np.ndarray] = [np.zeros(0, U)] * total
                for at, h, whose in shingle_sets(batch.column(k), n):
                    edge = np.searchsorted(whose, np.arange(int(whose[-1]) + 2)) if len(whose) else [0]
                    for i in range(len(edge) - 1):
                        own[at + i] = h[edge[i] : edge[i + 1]]
                sets.append(own)
            hit = []
            for x, y in zip(*sets, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def folded(rows: list[bytes], words: int) -> np.ndarray:
    """Sketches of one length, folded to ``words`` words of 64 bits; one a row."""
    x = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1, words)
    return np.bitwise_xor.reduce(x, axis=1)


def tile_pairs(c: np.ndarray, k: np.ndarray, n: np.ndarray, side: np.ndarray, cells: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different components k whose sketches don't exclude a link: of both sides 0 and 1, or within a side if there is but one."""
    order = np.lexsort((c, n))
    k, n, side, cells = k[order], n[order], side[order], [cells[i] for i in order.tolist()]
    # Sizes rise, so lengths of sketches do; those of linked sets differ by a factor of two at most.
    words = np.array([len(x) // 8 for x in cells])
    edge = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
    two = bool(side.min() != side.max())
    us, vs = [], []
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        w = int(words[a])
        end = int(edge[i + 2]) if i + 2 < len(edge) and words[b] == 2 * w else b
        x = np.concatenate([folded(cells[a:b], w), folded(cells[b:end], w)] if end > b else [folded(cells[a:b], w)])
        step = max(1, AT_ONCE // (w * (end - a)))
        for s in range(a, b, step):
            t = min(b, s + step)
            differ = np.bitwise_count(x[s - a : t - a, None, :] ^ x[None, s - a :, :]).sum(2, dtype=np.int64)
            later = np.arange(s, end)[None, :] > np.arange(s, t)[:, None]
            fits = later & (k[s:t, None] != k[None, s:end]) & (100 * n[s:t, None] >= percent * n[None, s:end])
            if two:
                fits &= side[s:t, None] != side[None, s:end]
            fits &= differ * (100 + percent) <= (n[s:t, None] + n[None, s:end]) * (100 - percent)
            u, v = np.nonzero(fits)
            us.append(order[u + s])
            vs.append(order[v + s])
    return np.concatenate(us), np.concatenate(vs)


def elsewhere(u: np.ndarray, v: np.ndarray, lists: list[list[int]], g: int) -> np.ndarray:
    """Whether the members u and v both list a group that comes before g; lists hold a few of each member's groups, in one order for all."""
    # From each list only what comes before g counts, so that a group in both comes before it.
    before = np.zeros((len(lists), LISTED), np.int64)
    known = np.zeros((len(lists), LISTED), bool)
    for i, x in enumerate(lists):
        own = x[: x.index(g)] if g in x else x
        before[i, : len(own)], known[i, : len(own)] = own, True
    same = (before[u][:, :, None] == before[v][:, None, :]) & known[u][:, :, None] & known[v][:, None, :]
    return same.any(axis=(1, 2))


def pairs_left(shared: DataFrame, found: DataFrame | None, cells: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v of different components that share a signature, but for those that their sketches exclude; of all classes if no components are given."""
    own = shared.select("g", "c", "n", "many")
    if found is None:
        own = own.withColumn("k", F.col("c"))
    else:  # groups of two met in the first round
        own = own.where("many > 2").join(found.select(F.col("node").alias("c"), "least"), "c", "left").withColumn("k", F.coalesce("least", "c")).drop("least")
    # Groups with the same members need one look.
    told = own.groupBy("g").agg(F.min("k").alias("x"), F.max("k").alias("y"), F.count("*").alias("m"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("h")).where("x <> y")
    left = saved(own.join(told.groupBy("m", "h").agg(F.min("g").alias("g")).select("g"), "g"))
    # A pair comes out of the first group that both list, largest groups first.
    lists = left.groupBy("c").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("many")).alias("a"), "g"))), 1, LISTED)["g"].alias("lists"))
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    at = left.withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = at.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "c", "k", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))
    rows = tiles.join(cells.join(lists, "c"), "c").select("g", "i", "j", "side", "c", "k", F.col("size").alias("n"), "cells", "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None

        def compared() -> pa.RecordBatch:
            b = pa.Table.from_batches(held)
            side, c, k, n = (b.column(x).to_numpy() for x in ("side", "c", "k", "n"))
            u, v = tile_pairs(c, k, n.astype(np.int64), side, b.column("cells").to_pylist(), percent)
            if len(u):
                here = ~elsewhere(u, v, b.column("lists").to_pylist(), key[0])
                u, v = u[here], v[here]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(c[u], c[v]), pa.int64()), pa.array(np.maximum(c[u], c[v]), pa.int64())], ["u", "v"])

        for b in batches:
            keys = [b.column(x).to_numpy() for x in ("g", "i", "j")]
            edge = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1).tolist(), len(b)] if len(b) else []
            for s, t in zip(edge[:-1], edge[1:], strict=True):
                if (own_key := tuple(int(x[s]) for x in keys)) != key and held:
                    yield compared()
                    held = []
                key = own_key
                held.append(b.slice(s, t - s))
        if held:
            yield compared()

    dealt = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    pairs = saved(dealt.mapInArrow(run, "u long, v long").distinct())
    forget(left)
    return pairs


def indexed(docs: DataFrame, key: str, text: str, percent: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Saved tables: the rows with their classes, the groups of classes that share a signature, and one text and the sketch of each of those classes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            size, c = np.zeros(len(b), np.int64), np.zeros(len(b), U)
            for at, h, whose in shingle_sets(b.column(1), n):
                count = int(whose[-1]) + 1 if len(whose) else 0
                size[at : at + count], c[at : at + count] = class_ids(h, whose, count)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size), pa.array(c.view(np.int64))], [key, "__k", "n_shingles", "__c"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, F.xxhash64(key, text).alias("__k"))
    base = saved(rows.mapInArrow(measure, f"`{key}` {kind}, __k long, n_shingles long, __c long"))
    told = base.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).first()
    buckets = max(16, int((told.s or 0) * 0.45) // BUCKET_SIGNATURES)
    frequent = frequent_shingles(docs, text, told.n, n)
    shared = groups(signature_blocks(docs, text, buckets, frequent, percent, n), buckets, HELD)

    # Texts of the classes that may be linked, one of each.
    taking = shared.select(F.col("c").alias("__c")).distinct()
    firsts = base.groupBy("__c").agg(F.min("__k").alias("__k")).join(taking, "__c")
    texts = saved(rows.join(firsts, "__k").dropDuplicates(["__c"]).select(F.col("__c").alias("c"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    cells = saved(sketches(texts, n))

    return base, shared, texts, cells


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """key, n_shingles and component_id (the least key reachable by links) of every row."""
    base, shared, texts, cells = indexed(docs, key, text, percent, n)
    first = shared.where("c <> c0").where(f"100 * least(n, n0) >= {percent} * greatest(n, n0)").select(F.col("c0").alias("u"), F.col("c").alias("v")).distinct()
    close = saved(plausible(first, cells, percent))
    links = saved(verified(close, texts, percent, n))
    found = components(links)
    more = pairs_left(shared, found, cells, percent)
    forget(shared, cells, close)
    added = saved(verified(more, texts, percent, n))
    if not added.isEmpty():
        forget(found)
        found = components(links.unionByName(added))
    forget(texts, links, more, added)

    # The least key of each class, then of each component.
    classes = base.where("n_shingles > 0").groupBy("__c").agg(F.min(key).alias("__first"))
    joined = classes.join(found.select(F.col("node").alias("__c"), F.col("least").alias("__k")), "__c", "left").withColumn("__k", F.coalesce("__k", "__c"))
    least = joined.groupBy("__k").agg(F.min("__first").alias("component_id"))
    by_class = joined.join(least, "__k").select("__c", "component_id")
    linked = base.join(by_class.withColumnRenamed("component_id", "__component"), "__c", "left")
    return linked.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("__component")).otherwise(F.col(key)).alias("component_id"))


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """key, n_shingles, class_id and n_links (other rows that a row is linked with, those of its own set included) of every row; and the links between classes, u and v.

    All candidates are verified, also within components, so this costs what its links are in number.
    """
    base, shared, texts, cells = indexed(docs, key, text, percent, n)
    pairs = pairs_left(shared, None, cells, percent)
    links = saved(verified(pairs, texts, percent, n))
    forget(shared, texts, cells, pairs)
    sizes = base.where("n_shingles > 0").groupBy("__c").agg(F.count("*").alias("__n"))
    both = links.select(F.col("u").alias("__c"), F.col("v").alias("__o")).unionByName(links.select(F.col("v").alias("__c"), F.col("u").alias("__o")))
    others = both.join(sizes.select(F.col("__c").alias("__o"), "__n"), "__o").groupBy("__c").agg(F.sum("__n").alias("__others"))
    told = sizes.join(others, "__c", "left").select("__c", (F.col("__n") - 1 + F.coalesce("__others", F.lit(0))).alias("__links"))
    linked = base.join(told, "__c", "left")
    return linked.select(key, "n_shingles", F.col("__c").alias("class_id"), F.when(F.col("n_shingles") > 0, F.col("__links")).otherwise(0).alias("n_links")), links


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(source: str = "documents") -> str:
    """DuckDB's SQL for the query: all pairs that share a shingle, and what each document reaches."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM {source}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {SHINGLE - 1}), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - {SHINGLE - 1}, 1) END)) AS i FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM {source}
  UNION SELECT b, other FROM reached JOIN steps ON a = doc_id WHERE other < b)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM {source} d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""
