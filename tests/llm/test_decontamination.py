"""Decontamination against brute force, on the smallest tables and rows made to be awkward."""

import re

import duckdb
import pandas as pd
import pytest

from cucurbit.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    """Words, the set of hit words, and the items found."""
    ws, hit, found = split(text), set(), set()
    for item, other in items:
        other = split(other)
        keys = {tuple(other[i : i + 10]) for i in range(max(len(other) - 9, 1))} if other else set()
        for key in keys:
            for s in range(len(ws) - len(key) + 1):
                if tuple(ws[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    found |= {item} - {None}
    return len(ws), hit, found


ITEM = " ".join(f"wörd{i}" for i in range(14))
ITEMS = [(1, ITEM), (2, "Alpha beta, GAMMA 7"), (10, "same thing"), (9, "Same  thing!"), (2, "second text of two"), (None, "item without id"), (11, None), (12, "?!"), (13, "a a a a a a a a a a a a")]
TEXTS = [
    None, "", " ?! ", "alpha BETA gamma-7", "alpha beta gamma 77", "same thing, same thing", "a " * 30, "a " * 9, f"Vorher {ITEM.upper().replace('Ö', 'ö')}, danach", ITEM.replace("wörd5", "other"),
    " ".join(ITEM.split()[3:13]) + " " + " ".join(ITEM.split()[1:11]), "the ITEM without ID here", "second text of two alpha beta gamma 7", "x" * 5000, "漢字 same thing 🙂", "same\x00thing", ("filler words here " * 9000) + ITEM,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None, t, 7, ["x"], "i", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, n_words int, spans array<string>, items string, item long")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 60])
def test_brute_force(docs, items, block_words):
    found = decontamination.decontaminate(docs, items, block_words=block_words).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        n, hit, names = brute(r.text, ITEMS)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), sorted(names)), r.text
        # Spans cut out of the original text hold just the hit words, in order.
        ws = split(r.text)
        assert [w for s in r.spans for w in split(r.text[s.start : s.stop])] == [ws[k] for k in sorted(hit)]
        assert all(r.spans[k].stop < r.spans[k + 1].start and r.spans[k].words > 0 for k in range(len(r.spans) - 1))


def test_empty_tables(spark, docs, items):
    none = decontamination.decontaminate(docs, items.where("false")).agg({"n_hit": "sum", "*": "count"}).first()
    assert none["sum(n_hit)"] == 0 and none["count(1)"] == len(TEXTS) + 2
    assert decontamination.decontaminate(docs.where("false"), items).count() == 0


def test_query(spark, sf_dir):
    docs, items = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {r.doc_id: r for r in decontamination.op13_decontamination(spark, sf_dir).collect()}
    assert any(r.contaminated for r in found.values()) and not all(r.contaminated for r in found.values())
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("benchmark", items)
    want = con.execute(decontamination.oracle_sql()).df()
    assert {tuple(r) for r in want.itertuples(index=False)} == {tuple(r[c] for c in want.columns) for r in found.values()}


def test_symbols_of_many_words():
    rows = [(k, f"a{k} b{k} c{k % 7}") for k in range(3000)]
    m = decontamination.Matcher(rows)
    hit, found = m.scan(b"a5 b5 c5 x a2999 b2999 c3 a4 b5 c5".split())
    assert hit.tolist() == [0, 1, 2, 4, 5, 6] and found == {5, 2999}
