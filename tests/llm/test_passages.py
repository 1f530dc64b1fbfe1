"""Passages against brute force: short ones with edits, and mixed templates."""

import random

import numpy as np
import pytest

from cucurbit.llm import passages


def tokens(words):
    """Shingles as numbers, as the kernels give them."""
    return np.array([hash(tuple(words[i : i + 5])) & (1 << 63) - 1 for i in range(len(words) - 4)], np.uint64)


def qualifies(x, y):
    """Whether some stretches of 46 shingles or more on one diagonal have 75 percent of their union in common."""
    for k in range(len(y) - 45):
        for m in range(k + 46, len(y) + 1):
            u, v = set(x[k:m].tolist()), set(y[k:m].tolist())
            if 100 * len(u & v) >= 75 * len(u | v):
                return True
    return False


@pytest.mark.parametrize("n", [50, 52, 55, 60, 65, 70])
def test_one_word_edits(n):
    own = [f"w{i}" for i in range(n)]
    for at in range(n):
        x, y = tokens(own), tokens([*own[:at], "changed", *own[at + 1 :]])
        assert qualifies(x, y)
        found = passages.alike(x, y)
        assert len(found) == 1, at
        i, j, k, m = found[0]
        # No side of the edit is cut off, but for misses at the ends.
        assert (m - k) + 5 >= n - 4 and (j - i) + 5 >= n - 4, at


def test_edits_in_context():
    r = random.Random(5)
    for trial in range(300):
        n = r.randrange(50, 72)
        own = [f"w{i}" for i in range(n)]
        other = list(own)
        for at in r.sample(range(n), r.choice([1, 1, 2, 2, 3])):
            other[at] = "changed"
        x, y = ([*(f"{s}a{i}" for i in range(9)), *body, *(f"{s}b{i}" for i in range(9))] for s, body in (("x", own), ("y", other)))
        x, y = tokens(x), tokens(y)
        assert bool(passages.alike(x, y)) == qualifies(x, y), trial


def filled_in(edits):
    """Texts of three by each of 40 variants: a template of 36 words with 24 words of the variant, between words of their own."""
    r = random.Random(11)
    rows = []
    for v in range(40):
        body = [w for part in range(3) for w in (*(f"t{part}x{i}" for i in range(12)), *(f"v{v}p{part}x{i}" for i in range(8)))]
        for copy in range(3):
            own = list(body)
            for at in r.sample(range(len(own)), edits if copy else 0):
                own[at] = f"edit{v}c{copy}"
            at = 3 * v + copy
            rows.append((at, " ".join([*(f"a{at}x{i}" for i in range(70)), *own, *(f"b{at}x{i}" for i in range(70))])))
    return rows


@pytest.mark.parametrize(("edits", "share"), [(0, 1.0), (1, 0.95)])
def test_mixed_templates(spark, edits, share):
    rows = filled_in(edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = [tokens(t.split()) for _, t in rows]
    want = {i for v in range(40) for i in range(3 * v, 3 * v + 3) if any(j != i and passages.alike(split[i], split[j]) for j in range(3 * v, 3 * v + 3))}
    assert len(want) == 120
    found = {r.doc_id for r in passages.passage_report(docs)[1].where("n_repeated >= 50").collect()}
    print(f"edits {edits}: {len(found & want)} of {len(want)} texts")
    assert found <= want and len(found) >= share * len(want)


def test_shared_by_many(spark):
    """A passage of many texts is listed once for all of them, and all but one text give it up."""
    n = 3000
    sides = spark.createDataFrame([(7, i, 0, 5, 60) for i in range(n)] + [(8, i, 1, 5, 60 + i % 3) for i in range(40)], "__c long, pair long, side int, s int, e int")
    one_of = spark.createDataFrame([(7, 70), (8, 80)], "__c long, __k long")
    wanted, salted = passages.wanted_stretches(sides, one_of)
    assert wanted.where("not once").count() == 40 and [(r["__k"], r["side"]) for r in wanted.where("once").collect()] == [(70, 3)]
    assert salted.count() == n and max(r["count"] for r in salted.groupBy("copy").count().collect()) < n / 2
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(20))} {shared} {' '.join(f'b{i}x{k}' for k in range(20))}") for i in range(600)]
    found = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()
    assert all(r.n_repeated >= 60 for r in found) and sum(r.n_removed >= 60 for r in found) == 599


@pytest.mark.parametrize("kind", ["exact", "changed", "dropped", "added"])
def test_recall_of_short_passages(spark, kind):
    """Passages of 50 to 70 words with one change, each in two texts of random words: what a comparison of all such pairs finds is found."""
    r, rows = random.Random(kind), []
    for i in range(120):
        body = [f"p{i}x{k}" for k in range(r.randrange(50, 71))]
        for copy in range(2):
            own, at = list(body), r.randrange(len(body))
            if copy and kind != "exact":
                own[at : at + (kind != "added")] = [] if kind == "dropped" else [f"new{i}"]
            left, right = ([f"{side}{i}c{copy}x{k}" for k in range(r.randrange(10, 120))] for side in "lr")
            rows.append((2 * i + copy, " ".join([*left, *own, *right])))
    split = [tokens(t.split()) for _, t in rows]
    want = {k for i in range(120) if passages.alike(split[2 * i], split[2 * i + 1]) for k in (2 * i, 2 * i + 1)}
    found = {x.doc_id for x in passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string"))[1].where("n_repeated > 0").collect()}
    print(f"{kind}: {len(found & want)} of {len(want)} texts")
    assert found <= want and len(found) >= 0.95 * len(want)


@pytest.mark.parametrize(("variants", "left", "own", "right"), [(40, 22, 8, 22), (150, 22, 8, 22), (400, 22, 8, 22), (400, 21, 8, 21), (400, 24, 14, 24), (400, 18, 20, 18)])
def test_template_with_one_edit(spark, variants, left, own, right):
    """Two texts of each variant, one with a word changed: most of a passage's words are those of all variants."""
    r, rows = random.Random(variants), []
    for v in range(variants):
        body = [*(f"tl{i}" for i in range(left)), *(f"v{v}x{i}" for i in range(own)), *(f"tr{i}" for i in range(right))]
        for copy in range(2):
            text = list(body)
            if copy:
                text[r.randrange(len(text))] = f"edit{v}"
            rows.append((2 * v + copy, " ".join([*(f"a{v}c{copy}x{i}" for i in range(30)), *text, *(f"b{v}c{copy}x{i}" for i in range(30))])))
    split = [tokens(t.split()) for _, t in rows]
    want = {k for v in range(variants) if passages.alike(split[2 * v], split[2 * v + 1]) for k in (2 * v, 2 * v + 1)}
    found = {x.doc_id for x in passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string"))[1].where("n_repeated > 0").collect()}
    print(f"{variants} variants, {left} + {own} + {right}: {len(found & want)} of {len(want)} texts")
    assert found <= want and len(found) >= 0.95 * len(want)


def test_every_key_pairs(spark):
    """Two windows of a large group share the last key only, and each of them shares the other keys with a window of its own."""
    n = passages.KEYS - 1
    # Numbers of classes: 0 comes first, 1 to n - 1 are partners of x, then y's partners; others lie between x and y.
    x, y = 2 * n, 2 * n + 2
    keys = np.arange(1, (2 * n + 3) * passages.KEYS + 1, dtype=np.uint16).reshape(passages.KEYS, -1)
    for k in range(1, n):
        keys[k, k], keys[k, n + k] = keys[k, x], keys[k, y]
    keys[n, y] = keys[n, x]
    m = keys.shape[1]
    row = (0, np.full(m, 5, np.uint32), np.arange(m, dtype=np.uint16), np.full(m, 30, np.int32), np.full((2, m), 30, np.uint16), keys, np.arange(100, 100 + m, dtype=np.uint64))
    blocks = spark.createDataFrame([(row[0], *(bytearray(np.ascontiguousarray(v).tobytes()) for v in row[1:]))], "bucket int, sig binary, own binary, mids binary, spans binary, keys binary, classes binary")
    met = {(r.a - 100, r.b - 100) for r in passages.meetings(blocks, 1).collect()}
    assert (x, y) in met
    assert all((k, x) in met and (n + k, y) in met for k in range(1, n))
