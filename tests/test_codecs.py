"""Filters: round trips, known values, and refusal of broken streams."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gridspark.errors import FormatError
from gridspark.functions import codecs as K
from gridspark.functions import szip

DATA = [b"", b"a", b"hello " * 50, (np.arange(10_000) % 251).astype("<u4").tobytes(), bytes(65_536), bytes(range(256)) * 400]


def test_lookup3_values():
    # Fixed values published with the hash.
    assert K.lookup3(b"Four score and seven years ago") == 0x17770551 and K.lookup3(b"") == 0xDEADBEEF


def test_fletcher_values():
    # Fixed values published with the checksum (words are big-endian here).
    assert K.fletcher32(b"\0\0\0\0") == 0 and K.fletcher32(b"\0\1") == 0x00010001 and K.fletcher32(b"\xff\xff") == 0xFFFFFFFF
    with pytest.raises(FormatError):
        K._check(K._add_checksum(b"abcd")[:-1] + b"\x77")


@pytest.mark.parametrize("data", DATA, ids=range(len(DATA)))
def test_round_trips(data):
    assert K.lzf_decode(K.lzf_encode(data)) == data
    assert K.blosclz_decode(K.blosclz_encode(data), len(data)) == data
    for size in (1, 2, 4, 8):
        assert K.unshuffle(K.shuffle(data, size), size) == data == K.bit_unshuffle(K.bit_shuffle(data, size), size)
        for codec in K._BLOSC_CODECS:
            for shuffled in (0, 1, 2):
                assert K.blosc_decode(K.blosc_encode(data, size, shuffled, codec)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_any_bytes(data):
    assert K.lzf_decode(K.lzf_encode(data)) == data and K.blosclz_decode(K.blosclz_encode(data), len(data)) == data
    pipe = K.Pipeline([K.Filter("shuffle"), K.Filter("deflate"), K.Filter("fletcher32"), K.Filter("lzf")])
    assert pipe.decode(pipe.encode(data, 4), 4) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_broken_streams_are_refused_or_read(data):
    for name in ("lzf", "blosc", "fletcher32", "deflate"):
        try:
            K.decode_one(K.Filter(name), data, 1)
        except FormatError as e:
            assert str(e)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(["<i1", "<u2", "<i4", "<i8", "<u8"]), st.lists(st.integers(-(2**63), 2**64 - 1), min_size=1, max_size=50))
def test_scale_offset_is_exact(kind, values):
    d = np.dtype(kind)
    info = np.iinfo(d)
    v = np.array([min(max(x, info.min), info.max) for x in values], d)
    p = (2, 0, len(v), 0, d.itemsize, int(d.kind == "i"), 0, 0)
    assert K.scaleoffset_decode(K.scaleoffset_encode(v.tobytes(), p), p) == v.tobytes()


def test_scale_offset_floats_and_n_bit():
    v, p = np.arange(1000) / 7, (0, 3, 1000, 1, 8, 0, 0, 0)
    assert np.abs(np.frombuffer(K.scaleoffset_decode(K.scaleoffset_encode(v.tobytes(), p), p)) - v).max() <= 5e-4
    v, p = (np.random.default_rng(0).integers(0, 2**11, 999) << 3).astype("<u4"), (8, 0, 999, 1, 4, 0, 11, 3)
    packed = K.nbit_encode(v.tobytes(), p)
    assert len(packed) == -(-999 * 11 // 8) and K.nbit_decode(packed, p) == v.tobytes()


@pytest.mark.parametrize("bits,kind", [(8, "u1"), (16, "<u2"), (32, "<u4"), (16, ">u2")])
@pytest.mark.parametrize("nearest", [True, False])
def test_szip(bits, kind, nearest):
    g = np.random.default_rng(0)
    for v in (np.arange(3000) // 3 % 200, g.integers(0, 2**bits, 2999), np.zeros(1000), np.full(7, 5)):
        raw = v.astype(kind).tobytes()
        big = kind[0] == ">"
        assert szip.decode(szip.encode(raw, 8, bits, 64, nearest, big), len(raw), 8, bits, 64, nearest, big) == raw


def test_columns(spark):
    pipe = K.Pipeline([K.Filter("shuffle"), K.Filter("deflate", (9,))])
    df = spark.createDataFrame([(x,) for x in DATA] + [(None,)], "raw binary")
    out = df.withColumn("e", K.encode_column("raw", pipe, 4)).withColumn("d", K.decode_column("e", pipe, 4))
    assert out.where("not (raw <=> d)").count() == 0
