"""Operator 1: how much is called for a text, and that the stored form stays the same."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np

from verbaspark.llm import jpeg, op1_jpeg


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "th", "ti", "ou", "é", "ß", "on"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_op1_calls_for_a_text():
    """A text of 2,000 bytes is stored, read back and transformed in at most 1,400 calls (above 2,000 before)."""
    text = _prose(3, 500).encode()[:2000]

    def work():
        image = jpeg.coefficients(jpeg.encode(op1_jpeg.padded(text)))
        return jpeg.payload(image), op1_jpeg.feature(jpeg.rgb(image))

    want, calls = work(), Counter()  # the tables are made
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = work()
    finally:
        sys.setprofile(None)
    assert got == want and got[0] == op1_jpeg.padded(text)
    assert calls["call"] + calls["c_call"] <= 1400


def test_op1_stored_bytes():
    """The stored form is the one that earlier readers know."""
    r = random.Random(8)
    texts = [b"", b"a", bytes(range(256)) * 5, _prose(3, 400).encode(), bytes(r.choice([95, 96, 97, 0]) for _ in range(4000)), b"`" * 3000, r.randbytes(20_000)]
    sha = hashlib.sha256()
    for t in texts:
        media = jpeg.encode(op1_jpeg.padded(t))
        sha.update(media + op1_jpeg.feature(jpeg.decode(media)).encode())
    assert sha.hexdigest() == "1725535ef0365924e830ac8490127aaba74c6264cd8a7034c2bc75d7c6ce1092"


def test_op1_long_differences(spark):
    """A difference whose code and bits are longer than 16 bits is read; one of 200 bits is damage: null, never an error."""
    head = jpeg._HEAD + jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))

    def file(size, *values):
        table = jpeg._segment(0xC4, bytes([0] + [0] * 7 + [1] + [0] * 8 + [size]))
        bits = "".join("0" * 8 + f"{v:0{size}b}" for v in values)
        return head + table + jpeg._start([1], 0, 0, 0, 0) + jpeg._stuffed(np.array([int(b) for b in bits], np.uint8)) + b"\xff\xd9"

    image = jpeg.coefficients(file(10, 1000, 5))
    assert image.components[1].blocks[0, :, 0].tolist() == [1000, 1000 + 5 - 1023]
    images = spark.createDataFrame([(1, file(10, 1000, 5)), (2, file(200, 1, 1))], "id long, im binary")
    got = {r.id: r for r in op1_jpeg.tensors(images, "id", "im").collect()}
    assert got[1].width == 16 and got[2].rgb is None
