"""The source audit against brute force, on the smallest table and rows made to be awkward."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cucurbit.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least):
    """rows: text, lang, source.  Rows of the result, with Python's whole numbers."""
    docs, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        all_of = sum((c for (k, _), c in counts.items() if k == lang), Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = share(own), share(all_of)
        parts = {"pair": [(s, sum(abs(p[t] - r[t]) for t in kept)) for (k, s), c in counts.items() if k == lang and s != source for r in [share(c)]], "term": [(t, p[t] - q[t]) for t in kept if own[t] and p[t] > q[t]]}
        for part, items in parts.items():
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: 50 if part == "term" else None]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def awkward():
    r = random.Random(3)
    words = [f"w{'abcde'[k % 5]}{chr(97 + k // 5)}" for k in range(100)] + ["Ñu", "ñu", "漢字", "it's", "a1b", "x" * 3000]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(40))), "en", f"s{min(r.randrange(12), 7)}") for _ in range(300)]
    rows += [("hot words hot", "en", "s0")] * 300  # a third of all rows
    rows += [(None, None, None), ("", "de", ""), (None, "de", "x"), ("only here", "fr", "one"), ("Only HERE", "fr", None), ("wa " * 20_000, "en", "long"), ("?!", "en", "nothing"), ("tie tie", "es", "b"), ("tie tie", "es", "a"), ("other", "es", "c")]
    return rows


def result(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("least, block", [(1, 500), (3, 3), (10_000, 500)])
def test_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", 40 if block == 3 else divergence.CELLS)
    docs = spark.createDataFrame([(*x, 1, "t") for x in awkward()], "text string, lang string, source string, docs long, term string").repartition(5)
    assert result(divergence.divergence(docs, least)) == brute(awkward(), least)


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert result(divergence.op12_divergence(spark, sf_dir)) == brute([tuple(r) for r in rows], 30)


@pytest.mark.parametrize("burst", [512, 3])
def test_trie(monkeypatch, burst):
    monkeypatch.setattr(divergence, "BURST", burst)
    r = random.Random(1)
    terms = ["".join(r.choice("abñ漢") for _ in range(r.randrange(1, 6))).encode() for _ in range(500)]
    tries, want = [divergence.Trie() for _ in range(3)], defaultdict(Counter)
    for k, t in enumerate(terms):
        leaf = tries[k % 3].leaf(t)
        leaf["s"] = leaf.get("s", 0) + k
        leaf[divergence.DOCS] += 1
        want[t].update({"s": k, "docs": 1})
    assert sum(t.leaves for t in tries) >= len(want)
    walks = [list(t.walk()) for t in tries]
    assert all([t for t, _ in w] == sorted({t for t, _ in w}) for w in walks)
    rows = sorted((row for t in tries for b in divergence._rows("x", t) for row in b.to_pylist()), key=lambda r: r["term"].encode())
    merged = [r for b in divergence._merged(1)(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert [(r["term"].encode(), r["docs"], r["sources"], r["counts"]) for r in merged] == [(t, c["docs"], ["s"], [c["s"]]) for t, c in sorted(want.items())]


def test_large_counts_are_exact():
    import numpy as np

    n = 7 * 10**17
    assert divergence.shares(np.array([[n]]), np.array([n + 3]), 11)[0, 0] == 1 + 10**9 * (n + 5) // (n + 3 + 55)
