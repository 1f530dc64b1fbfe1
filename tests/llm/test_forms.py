"""Images, placement, token pieces and long texts of the dealt operators against slow forms of the same."""

import hashlib
import io
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cucurbit.llm import bpe, media, packing, sharding, token_counts, toxicity

rng = np.random.default_rng(4)


# -- images -------------------------------------------------------------------------------------------


def slow_resize(image, height, width):
    """Sample by sample, from the overlap of each pair of squares."""
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1, total = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width, 0.0
            for y in range(h):
                for x in range(w):
                    total += max(0.0, min(y + 1, y1) - max(y, y0)) * max(0.0, min(x + 1, x1) - max(x, x0)) * float(image[y, x])
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape", [(24, 24, 8, 9), (1, 1, 8, 9), (3, 5, 8, 9), (5, 3, 2, 2), (96, 24, 8, 9), (7, 7, 7, 7), (10, 10, 1, 1), (17, 13, 4, 5)])
def test_area_resize(shape):
    image = rng.integers(0, 256, shape[:2]).astype(np.uint8)
    np.testing.assert_allclose(media.area_resize(image, *shape[2:]), slow_resize(image, *shape[2:]))
    both = np.stack([image, 255 - image])
    np.testing.assert_allclose(media.area_resize(both, *shape[2:])[1], slow_resize(255 - image, *shape[2:]))


def slow_hash(image):
    small = slow_resize(image, 8, 9)
    bits = "".join("1" if small[y, x + 1] - small[y, x] > 1e-9 else "0" for y in range(8) for x in range(8))
    return int(bits, 2)


def test_difference_hash():
    for shape in ((24, 24), (48, 24), (5, 40)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert int(media.difference_hash(image)) == slow_hash(image)
    ramp = np.tile(np.arange(24, dtype=np.uint8), (24, 1))
    assert int(media.difference_hash(ramp)) == 2**64 - 1 and int(media.difference_hash(ramp[:, ::-1])) == 0


GREY, COLOUR, WIDE = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 3, 3)), rng.integers(0, 65536, (3, 4))


@pytest.mark.parametrize(
    "raw, want",
    [
        (b"P1\n# note\n3 2\n1 0 1\n0 1 0\n", np.array([[0, 255, 0], [255, 0, 255]])),
        (b"P4\n10 2\n" + np.packbits(np.eye(2, 10, dtype=np.uint8), axis=1).tobytes(), (1 - np.eye(2, 10)) * 255),
        (b"P2 7 5 255\n" + " ".join(map(str, GREY.ravel())).encode(), GREY),
        (b"P3\n3 4\n255\n" + "\n".join(map(str, COLOUR.ravel())).encode(), COLOUR),
        (b"P5\n#a\n7 5\n255\n" + GREY.astype(np.uint8).tobytes(), GREY),
        (b"P6 3 4 255\n" + COLOUR.astype(np.uint8).tobytes(), COLOUR),
        (b"P5\n4 3\n65535\n" + WIDE.astype(">u2").tobytes(), WIDE),
        (b"P2\n4 3\n65535\n" + " ".join(map(str, WIDE.ravel())).encode(), WIDE),
    ],
)
def test_netpbm(raw, want):
    got = media.decode(raw)
    assert got.dtype == (np.uint16 if want.max() > 255 else np.uint8) and np.array_equal(got, want)


def test_bmp():
    for shape in ((5, 7), (1, 1), (3, 4), (24, 24)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(media.decode(media.encode_bmp(image)), image)
    pixels = rng.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    for bits in (24, 32):
        stride = (5 * bits // 8 + 3) // 4 * 4
        rows = np.zeros((3, stride), np.uint8)
        samples = pixels[:, :, ::-1] if bits == 24 else np.dstack([pixels[:, :, ::-1], np.zeros((3, 5), np.uint8)])
        rows[:, : 5 * bits // 8] = samples.reshape(3, -1)
        for height, lines in ((3, rows[::-1]), (-3, rows)):
            head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, height, 1, bits, 0, rows.size, 0, 0, 0, 0)
            assert np.array_equal(media.decode(head + lines.tobytes()), pixels), (bits, height)


@pytest.mark.parametrize("raw", [b"", b"P5", b"P9 1 1 255 x", b"P5\n4 4\n255\nxx", b"BM", b"BM" + b"\0" * 60, b"P5\n2 2\n0\nxxxx", b"P2\n2 2\n255\n1 2 3"])
def test_no_image(raw):
    assert media.decode(raw) is None


def test_npy_tiles(spark):
    image = rng.integers(0, 256, (30, 50)).astype(np.uint8)
    colour = rng.integers(0, 256, (10, 10, 3)).astype(np.uint8)
    rows = [(1, media.encode_pgm(image.tobytes(), 50)), (2, media.encode_bmp(image)), (3, b"no image"), (4, None), (5, b"P6 10 10 255\n" + colour.tobytes())]
    frame = spark.createDataFrame(rows, "k long, raw binary")
    got = media.npy_tiles(frame, "k", "raw").collect()
    assert {r.k for r in got} == {1, 2, 5}
    for k in (1, 2):
        back = np.zeros((30, 50), np.uint8)
        for r in (r for r in got if r.k == k):
            t = np.load(io.BytesIO(r.npy))
            back[r.y : r.y + t.shape[0], r.x : r.x + t.shape[1]] = t
            assert r.dhash == f"{slow_hash(t):016x}"
        assert np.array_equal(back, image)
    small = media.npy_tiles(frame.where("k = 1"), "k", "raw", size=(12, 10)).first()
    assert np.array_equal(np.load(io.BytesIO(small.npy)), np.rint(slow_resize(image, 12, 10)).astype(np.uint8))
    assert media.npy_tiles(frame.where("false"), "k", "raw").count() == 0


def test_media_features_in_full(spark):
    """Stored form and feature too."""
    for text in (None, "", "abc", "x" * 576, "é" * 400, "word " * 3000):
        got = media.media_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        hashes = b"".join(slow_hash(t).to_bytes(8, "big") for t in image.reshape(-1, 24, 24))
        assert (got.media_bytes, got.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got.feature == f"{int(media.difference_hash(image)):016x}-{hashlib.sha256(hashes).hexdigest()[:16]}"
        assert got.bmp_sha256 == hashlib.sha256(media.encode_bmp(image)).hexdigest()
        if len(image) <= 96:
            assert int(media.difference_hash(image)) == slow_hash(image)


# -- placement ----------------------------------------------------------------------------------------


def slow_table(names, size):
    """Turns, one slot each, from each name's whole order of preference."""
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders.append(iter([(offset + i * skip) % size for i in range(size)]))
    owner = {}
    while len(owner) < size:
        for n, order in zip(names, orders, strict=True):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = n
    return owner


def test_placement(spark):
    """Each row against a table made otherwise and Spark's hash made by another library."""
    names = [f"shard-{i:03d}" for i in range(5)]
    owner = slow_table(names, 1009)
    got = sharding.place(spark.range(-500, 2500), ["id"], dict.fromkeys(names, 1), 1009).collect()
    assert len(got) == 3000
    for r in got:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.id), seed=42)
        slot = (h - (1 << 64) if h >> 63 else h) % 1009
        assert (r.slot, r.shard) == (slot, owner[slot])
    heavy = sharding.lookup_table({"a": 3, "b": 1, "c": 0}, 1009).tolist()
    assert abs(heavy.count(0) - 3 * heavy.count(1)) <= 3 and set(heavy) == {0, 1}
    for bad in (({"a": 1}, 1000), ({}, 1009), ({"a": 0}, 1009)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, 1), (5, 2), (5, 2)], "slot long, shard long").withColumn("k", F.col("slot"))
    got = sharding.place(frame, ["k"], {"a": 1, "b": 1}, 101).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.k == 5}) == 1


# -- tokens -------------------------------------------------------------------------------------------


def test_pieces_have_the_tokens_of_the_text():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["word", " the", "  two", "\n\n", "\t", "don't", " 's", "<|endoftext|>", "1234", "!?", "漢字仮名", "。", "、", "é", "_", "-", " ", "\r\n", "\x1c", "　", "\xa0", "🙂", "x。", "_。"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 120)))
        cut = list(token_counts.pieces(text, 8))
        assert "".join(cut) == text
        assert sum(len(own.encode(c, add_special_tokens=False).ids) for c in cut) == len(own.encode(text, add_special_tokens=False).ids), repr(text)
    assert len(list(token_counts.pieces("漢字、" * 20_000))) > 2 and len(list(token_counts.pieces("x" * 50_000))) == 1


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "Hello there, WORLD 123"), (2, None), (3, ""), (4, "naïve <|endoftext|> 漢字 🙂")]
    ids = bpe.bpe_encode(spark.createDataFrame(rows, "k long, text string"), path)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    for r in bpe.bpe_decode(ids, path).collect():
        want = own.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == want and r.decoded == own.decode(want, skip_special_tokens=False)
    nulls = bpe.bpe_decode(spark.createDataFrame([(None,)], "token_ids array<int>"), path).first()
    assert nulls.decoded == ""


def test_packing_in_many_groups(spark, monkeypatch):
    """Numbers are whole and each once, however small the groups."""
    monkeypatch.setattr(packing, "GROUP", 3)
    lengths = [7] * 40 + [2048] * 25 + [900] * 9 + [1]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    counts = {n: lengths.count(n) for n in set(lengths)}
    numbered = packing.numbered(pieces, ["doc_id"], counts, 3).collect()
    for n, c in counts.items():
        assert sorted(r.number for r in numbered if r.length == n) == list(range(c))
    found = packing.packed(pieces).collect()
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in held.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(found) == len(lengths) and len(held) == 25 + 5


# -- decoding -----------------------------------------------------------------------------------------


def small_model(texts):
    table, total = toxicity._class_table(), np.zeros(toxicity.CLASSES**3, np.int64)
    for t in texts * 20:
        c = table[np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32)].astype(np.int64)
        np.add.at(total, (c[:-2] * toxicity.CLASSES + c[1:-1]) * toxicity.CLASSES + c[2:], 1)
    return toxicity.log_probabilities(list(enumerate(total.tolist())))


def cost_of_best(text, model):
    """The cost of the cheapest of all paths through the lattice, by trying all of them."""
    best = -np.inf
    stack = [(0, toxicity.SPACE, toxicity.SPACE, 0.0, "")]
    while stack:
        at, a, b, score, before = stack.pop()
        if at == len(text):
            best = max(best, score + model[a, b, toxicity.SPACE])
            continue
        c, steps = text[at], []
        if c in toxicity.SEPARATORS:
            steps += [("", toxicity.COST_DROPPED_SEPARATOR), (" ", 0.0)]
        elif c in toxicity.CODE:
            steps.append((c, 0.0))
        else:
            steps.append((c, toxicity.COST_KEPT_SIGN if c in toxicity.LEET else 0.0))
        steps += [(x, toxicity.COST_LEET) for x in toxicity.LEET.get(c, "")]
        if c == before:
            steps.append(("", toxicity.COST_DROPPED_REPEAT))
        for said, cost in steps:
            if said:
                k = toxicity.CODE.get(said, toxicity.OTHER)
                stack.append((at + 1, b, k, score - cost + model[a, b, k], c))
            else:
                stack.append((at + 1, a, b, score - cost, c))
    return best


def test_viterbi_is_the_best_of_all_paths():
    model = small_model(["this is a fine old village", "the grass is a mass", "what a crass class"])
    r = random.Random(2)
    for _ in range(150):
        text = "".join(r.choice("aasscrlg15$.-@!1") for _ in range(r.randrange(11)))
        assert toxicity.best_path(text, model)[0] == pytest.approx(cost_of_best(text, model)), text


@pytest.mark.parametrize("disguise", [lambda w: w[:2] + w[2] * 3 + w[3:], lambda w: w[:2] + w[2] * 12 + w[3:], lambda w: w[:2] + w[2] * 40 + w[3:], lambda w: w.replace("a", "@"), lambda w: w.replace("a", "4").replace("l", "1"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: " ".join(w) + ".", lambda w: '"' + " ".join(w) + '",', lambda w: w.upper() + "!!"])
def test_disguises_score_as_the_word(spark, disguise):
    """A text with the word disguised scores no less than one with it plain, and clean texts score 0."""
    r = random.Random(6)
    words = "the quiet morning was cold and village slept well a fine old table stood in garden by wall people came to market for bread cheese".split()
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, f"{said(20)} {'blarvak ' if i % 4 == 0 else ''}{said(20)}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    tests = [(1000, f"{said(9)} blarvak {said(9)} blarvak"), (1001, f"{said(9)} {disguise('blarvak')} {said(9)} {disguise('blarvak')}"), (1002, said(30))]
    found = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows + tests, "doc_id long, text string"), labels).where("doc_id >= 1000").collect()}
    assert found[1000].predicted == 1 and found[1001].score >= 0.9 * found[1000].score and found[1002].score == 0
