"""Decoding of disguised words, however long the string and whatever signs it has."""

import numpy as np
import pytest

from cucurbit.llm import toxicity

PLAIN = ["this book is a fine old thing", "he has a glass and a mass of grass", "what a crass remark", "the class was in the grass", "an ass is a beast", "crass people pass the class", "the morning was cold and the village slept"]


@pytest.fixture(scope="module")
def model():
    table, total = toxicity._class_table(), np.zeros(toxicity.CLASSES**3, np.int64)
    for t in PLAIN * 20:
        c = table[np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32)].astype(np.int64)
        np.add.at(total, (c[:-2] * toxicity.CLASSES + c[1:-1]) * toxicity.CLASSES + c[2:], 1)
    return toxicity.log_probabilities(list(enumerate(total.tolist())))


@pytest.mark.parametrize(("written", "word"), [("a$$", "ass"), ("a55", "ass"), ("@$$", "ass"), ("cra$$", "crass"), ("(rass", "crass"), ("gra55!", "grass"), ("c-r-a-s-s", "crass"), ("crasss", "crass")])
def test_disguises(model, written, word):
    assert word in toxicity.restored_words(written, model)


@pytest.mark.parametrize("written", ["cr" + "a" * 80 + "ss", "the.morning.was.cold.and.the.village.slept.what.a.crass.remark.he.has.a.gra55", "-".join("morning" * 9) + ".cra$$"])
def test_long_strings(model, written):
    found = toxicity.restored_words(written, model)
    assert len(written) > 60 and {"crass", "grass"} & set(found), found


def test_plain_words_stay(model):
    assert toxicity.restored_words("(village)", model)[0] == "village"
    assert toxicity.restored_words("cold,", model) == ["cold"]
    assert toxicity.restored_words("***", model) == []


def test_very_long(model):
    assert toxicity.restore("1" * 20_000, model)
