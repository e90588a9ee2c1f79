"""Encoded vectors of corpus files."""

import base64
import struct

import pytest

from rankweave.functions import payloads


def test_payloads_are_read_and_written(spark):
    text = base64.b64encode(struct.pack("<f3b", 0.5, 127, -127, 0)).decode()
    df = spark.createDataFrame([(1, text), (2, "[0.25, -1, 2]"), (3, None)], "id int, v string")
    got = {r["id"]: r["x"] for r in df.select("id", payloads.decoded("v").alias("x")).collect()}
    assert got == {1: [63.5, -63.5, 0.0], 2: [0.25, -1.0, 2.0], 3: None}
    back = df.filter("id = 1").select(payloads.encoded(payloads.decoded("v"))).first()[0]
    assert back == text


def test_vectors_that_need_care():
    zero = payloads.write_vector([0.0, 0.0])
    assert base64.b64decode(zero) == bytes(6) and list(payloads.read_vector(zero)) == [0.0, 0.0]
    assert list(base64.b64decode(payloads.write_vector([127.0, 0.5, 1.5]))[4:]) == [127, 0, 2]  # half to even
    for short in (b"", b"\0\0\0", b"\0\0\0\0"):
        with pytest.raises(ValueError, match="too short"):
            payloads.read_vector(base64.b64encode(short).decode())
