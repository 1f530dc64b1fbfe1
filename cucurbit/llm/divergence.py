"""Operator 12: audit of how the sources of a language differ, by mergeable radix tries.

1. Each partition counts its terms into byte tries, one a language.  A node branches by byte once it
   has ``BURST`` terms below it, until then it holds what is left of them; a leaf has the number of
   documents with the term and a counter for each source.  When there are ``LEAVES`` leaves, they are
   written and new tries begun, so a task's memory is bounded.
2. The leaves are ranged by language and prefix, and come to a task in the order of one walk over all
   tries: merging the tries of a range is adding up the leaves of a term, which lie together.  A
   frequent term has one leaf for each trie, however often it occurs.
3. The walk over the kept leaves, in UTF-8 order, makes shares of counts, adds up the differences of
   all pairs of sources of a language and holds each source's ``TOP`` terms, by value and then by
   term.  Sums and candidates of tasks are put together by Spark.

The sources' totals that step 3 needs go to its tasks in blocks of ``BLOCK`` sources; languages of
more sources take a pass for each pair of blocks.  All shares are whole numbers and exact.

Defined results: null texts, languages and sources are read as ''; repeated rows count each; a group
without terms takes part with counts of 0, and a language without kept terms has pairs of value 0 and
no terms.  Ties go by the item's UTF-8 bytes.  Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, saved

MIN_DOCS = 30
TOP = 50
SCALE, SMOOTH = 1_000_000_000, 5
LEAVES = 300_000
#: Terms below a node that does not branch.
BURST = 512
#: Words counted before they go into the tries, each distinct one of a group once.
AT_ONCE = 1_000_000
BLOCK = 500
#: Cells of the sums over pairs that a task holds.
CELLS = 4_000_000
#: Terms whose shares are made together.
CHUNK = 1024
#: What is no term becomes a space: all but letters and bytes from 128 on; A to Z become small.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Where a leaf, a dict of counts by source, has its documents.
DOCS = None


class Node:
    """Children by byte, once there are any, and leaves by what is left of their terms."""

    __slots__ = ("kids", "held")

    def __init__(self):
        self.kids: dict[int, Node] | None = None
        self.held: dict[bytes, dict] = {}

    def burst(self) -> None:
        self.kids, held, self.held = {}, self.held, {}
        for rest, leaf in held.items():
            if not rest:
                self.held[rest] = leaf
                continue
            if (kid := self.kids.get(rest[0])) is None:
                kid = self.kids[rest[0]] = Node()
            kid.held[rest[1:]] = leaf


class Trie:
    """A byte trie with counters at its leaves; ``known`` has the leaves by term, for those that come again."""

    def __init__(self):
        self.root, self.known = Node(), {}

    @property
    def leaves(self) -> int:
        return len(self.known)

    def leaf(self, term: bytes) -> dict:
        """The leaf of a term, made if there is none."""
        if (leaf := self.known.get(term)) is not None:
            return leaf
        node, at = self.root, 0
        while node.kids is not None and at < len(term):
            if (kid := node.kids.get(term[at])) is None:
                kid = node.kids[term[at]] = Node()
            node, at = kid, at + 1
        leaf = self.known[term] = node.held[term[at:]] = {DOCS: 0}
        if node.kids is None and len(node.held) > BURST:
            node.burst()
        return leaf

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """Terms and leaves in the order of their bytes."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            for rest in sorted(node.held):
                yield before + rest, node.held[rest]
            for byte in sorted(node.kids or (), reverse=True):
                todo.append((before + bytes([byte]), node.kids[byte]))


SCHEMA = "lang string, term string, docs long, sources array<string>, counts array<long>"
NAMES = ["lang", "term", "docs", "sources", "counts"]


def _rows(lang: str, trie: Trie, most: int = 8192) -> Iterator[pa.RecordBatch]:
    """A trie's leaves as rows, in the order of the walk."""
    walk = trie.walk()
    while some := list(islice(walk, most)):
        docs = [leaf.pop(DOCS) for _, leaf in some]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(leaf) for _, leaf in some])]), pa.int32())
        sources, counts = (pa.array(list(chain.from_iterable(x)), t) for x, t in (((leaf for _, leaf in some), pa.string()), ((leaf.values() for _, leaf in some), pa.int64())))
        terms = pa.array([t for t, _ in some], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), terms, pa.array(docs), pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, counts)], NAMES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the partition's tries, and a row without a term for each group."""
    tries: dict[str, Trie] = defaultdict(Trie)
    groups: set[tuple[str, str]] = set()
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    seen = 0

    def into_tries() -> None:
        for (lang, source), (terms, docs) in counts.items():
            trie = tries[lang]
            known, find = trie.known.get, trie.leaf
            for term, n in terms.items():
                leaf = known(term) or find(term)
                leaf[source] = leaf.get(source, 0) + n
                leaf[DOCS] += docs[term]
        counts.clear()

    for b in parts(batches, 256):
        texts, langs, sources = pc.fill_null(b.column("text").cast(pa.large_binary()), b""), pc.fill_null(b.column("lang"), "").to_pylist(), pc.fill_null(b.column("source"), "").to_pylist()
        for text, lang, source in zip(texts, langs, sources, strict=True):
            groups.add((lang, source))
            terms = text.as_py().translate(NORMAL).split()
            own, docs = counts[lang, source]
            own.update(terms)
            docs.update(set(terms))
            seen += len(terms)
            if seen >= AT_ONCE:
                into_tries()
                seen = 0
                if sum(t.leaves for t in tries.values()) >= LEAVES:
                    for k, t in tries.items():
                        yield from _rows(k, t)
                    tries.clear()
    into_tries()
    for k, t in tries.items():
        yield from _rows(k, t)
    ordered = sorted(groups)
    for at in range(0, len(ordered), 4096):
        some = ordered[at : at + 4096]
        columns = ([k for k, _ in some], [None] * len(some), [0] * len(some), [[s] for _, s in some], [[0]] * len(some))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], NAMES)


def _runs(rows: pa.Table) -> np.ndarray:
    """Where the leaves of a term begin, in rows ordered by lang and term."""
    same = [pc.equal(rows[c][1:], rows[c][:-1]).to_numpy() for c in ("lang", "term")]
    return np.flatnonzero(np.concatenate([[True], ~(same[0] & same[1])]))


def _merge(rows: pa.Table, min_docs: int) -> pa.RecordBatch | None:
    """One leaf for each term that is in enough documents; the rows hold all leaves of their terms, in the order of a walk."""
    one = rows.combine_chunks()
    start = _runs(one)
    docs = np.add.reduceat(one["docs"].to_numpy(), start)
    size = np.diff([*start, len(one)])
    if not (enough := docs >= min_docs).any():
        return None
    one = one.filter(pa.array(np.repeat(enough, size))).combine_chunks()
    docs, size = docs[enough], size[enough]
    start = np.cumsum(size) - size
    lists, counts = one["sources"].chunk(0), one["counts"].chunk(0).flatten().to_numpy()
    sources = lists.flatten().dictionary_encode()
    each = np.repeat(np.repeat(np.arange(len(size)), size), np.diff(lists.offsets.to_numpy()))
    key = each * len(sources.dictionary) + sources.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    key = key[order][first]
    ends = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * len(sources.dictionary)), pa.int32())
    merged = [sources.dictionary.take(pa.array(key % len(sources.dictionary))), pa.array(np.add.reduceat(counts[order], first))]
    return pa.RecordBatch.from_arrays([*(one[c].combine_chunks().take(pa.array(start)) for c in ("lang", "term")), pa.array(docs), *(pa.ListArray.from_arrays(ends, x) for x in merged)], NAMES)


def _merged(min_docs: int):
    """Merges the walks of tries that Spark's sort has put into one: the leaves of a term lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in parts(batches, 8192):
            # The last term may go on in the next batch.
            last = int(_runs(pa.Table.from_batches([b]))[-1])
            if held and (last or any(held[-1].column(c)[0] != b.column(c)[0] for c in ("lang", "term"))):
                if (out := _merge(pa.Table.from_batches([*held, b.slice(0, last)]), min_docs)) is not None:
                    yield out
                held = []
            elif last and (out := _merge(pa.Table.from_batches([b.slice(0, last)]), min_docs)) is not None:
                yield out
            held.append(b.slice(last))
        if held and (out := _merge(pa.Table.from_batches(held), min_docs)) is not None:
            yield out

    return run


def kept_leaves(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Leaves of terms in enough documents of their language (lang, term, docs, sources, counts), in files ordered by lang and term; and all groups (lang, source).  Both are saved tables."""
    leaves = saved(docs.select("lang", "source", "text").mapInArrow(_count, SCHEMA))
    ranged = leaves.where("term is not null").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    groups = leaves.where("term is null").select("lang", F.explode("sources").alias("source")).distinct()
    return saved(ranged.mapInArrow(_merged(min_docs), SCHEMA)), saved(groups)


def group_totals(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, place (0 on, in the language), n (occurrences of kept terms), v (the language's kept terms) and n_lang."""
    n = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    v = leaves.groupBy("lang").agg(F.count("*").alias("v"))
    own = Window.partitionBy("lang")
    rows = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v"])
    return rows.withColumn("place", F.row_number().over(own.orderBy("source")) - 1).withColumn("n_lang", F.sum("n").over(own))


def shares(counts: np.ndarray, total, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * v)), exact."""
    if counts.max(initial=0) >= 2**63 // SCALE - SMOOTH:
        counts, total = counts.astype(object), np.asarray(total, object)
    return (1 + SCALE * (counts + SMOOTH) // (total + SMOOTH * v)).astype(np.int64)


class Walk:
    """Sums over pairs and candidates of one language and one pair of blocks of its sources, as leaves are passed."""

    def __init__(self, a: list, b: list, v: int, n_lang: int, same: bool):
        self.a, self.b, self.v, self.n_lang, self.same = a, b, v, n_lang, same
        self.sums = np.zeros((len(a), len(b)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in a]
        self.held: list[tuple[str, list, list]] = []

    def table(self, block: list) -> np.ndarray:
        place = {source: k for k, (source, _) in enumerate(block)}
        out = np.zeros((len(self.held), len(block)), np.int64)
        for row, (_, sources, counts) in enumerate(self.held):
            for s, n in zip(sources, counts, strict=True):
                if (k := place.get(s)) is not None:
                    out[row, k] = n
        return out

    def flush(self) -> None:
        if not self.held:
            return
        counts = self.table(self.a)
        p = shares(counts, np.array([n for _, n in self.a], np.int64), self.v)
        other = p if self.same else shares(self.table(self.b), np.array([n for _, n in self.b], np.int64), self.v)
        for k in range(len(self.a)):
            self.sums[k] += np.abs(p[:, k : k + 1] - other).sum(0)
        if self.same:
            q = shares(np.array([[sum(c)] for _, _, c in self.held]), self.n_lang, self.v)
            over = np.where(counts > 0, p - q, 0)
            for k in range(len(self.a)):
                rows = np.flatnonzero(over[:, k] > 0)
                if len(rows) > TOP:
                    rows = rows[over[rows, k] >= np.partition(over[rows, k], -TOP)[-TOP]]
                self.best[k] = sorted([*self.best[k], *((-int(over[r, k]), self.held[r][0].encode("utf-8")) for r in rows)])[:TOP]
        self.held = []

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        for i, j in np.argwhere(self.sums).tolist():
            one, two, value = self.a[i][0], self.b[j][0], int(self.sums[i, j])
            yield one, two, value
            if not self.same:
                yield two, one, value


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _walked(leaves: DataFrame, units: dict[str, list[tuple[list, list, int, int, bool]]]) -> DataFrame:
    shared = leaves.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[str, list[Walk]] = {}
        for b in parts(batches, CHUNK):
            for lang, term, sources, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "term", "sources", "counts")), strict=True):
                if lang not in walks:
                    walks[lang] = [Walk(*u) for u in shared.value.get(lang, ())]
                for w in walks[lang]:
                    w.held.append((term, sources, counts))
                    if len(w.held) >= CHUNK:
                        w.flush()
        for lang, own in walks.items():
            for w in own:
                w.flush()
                rows = [(lang, x, "pair", y, value) for x, y, value in w.pairs()]
                rows += [(lang, w.a[k][0], "term", t.decode("utf-8"), -minus) for k, best in enumerate(w.best) for minus, t in best]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096], strict=True), FOUND, strict=True)], schema=FOUND)

    return leaves.select("lang", "term", "sources", "counts").mapInArrow(run, "lang string, source string, part string, item string, value long")


def passes(totals: DataFrame) -> Iterator[dict[str, list[tuple[list, list, int, int, bool]]]]:
    """Pairs of blocks of sources for a walk each, by language; as many together as ``CELLS`` allows.  The driver holds two blocks of each language at most."""
    sizes = totals.where("v > 0").groupBy("lang").agg(F.count("*").alias("n"), F.max("v").alias("v"), F.max("n_lang").alias("n_lang")).orderBy("lang")
    units: dict[str, list] = defaultdict(list)
    cells = 0
    for r in sizes.toLocalIterator():
        block = lambda k, lang=r.lang: [(x.source, x.n) for x in totals.where((F.col("lang") == lang) & (F.floor(F.col("place") / BLOCK) == k)).orderBy("place").collect()]
        for i in range(-(-r.n // BLOCK)):
            a = block(i)
            for j in range(i, -(-r.n // BLOCK)):
                b = a if i == j else block(j)
                units[r.lang].append((a, b, r.v, r.n_lang, i == j))
                cells += len(a) * len(b)
                if cells >= CELLS // 4:
                    yield dict(units)
                    units, cells = defaultdict(list), 0
    if units:
        yield dict(units)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs: text, lang and source.  lang, source, part ('pair' or 'term'), item, value and rank."""
    leaves, groups = kept_leaves(docs, min_docs)
    totals = saved(group_totals(leaves, groups))
    nothing = docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long")
    found = nothing
    for units in passes(totals):
        found = found.unionByName(_walked(leaves, units))
    found = saved(found)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one, two = totals.select("lang", "source"), totals.select("lang", F.col("source").alias("item"))
    pairs = one.join(two, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(own)).unionByName(terms)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """DuckDB's SQL for the query."""
    share = lambda c, n: f"1 + {SCALE}::HUGEINT * ({c} + {SMOOTH}) // ({n} + {SMOOTH} * v)"
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
counted AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
own AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(c, 0) AS c
  FROM groups JOIN kept ON groups.lang = kept.lang LEFT JOIN counted ON counted.lang = groups.lang AND counted.source = groups.source AND counted.term = kept.term),
totals AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang, term) AS c_lang, sum(c) OVER (PARTITION BY lang) AS n_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM own),
shares AS (SELECT lang, source, term, c, {share("c", "n")} AS p, {share("c_lang", "n_lang")} AS q FROM totals),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {TOP}"""
