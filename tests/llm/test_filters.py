"""Filters and word hashes: what a task holds does not grow with the filter or with a text."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import filters, kernels


def test_filter_has_every_hash_and_little_else(spark):
    values = np.random.default_rng(5).integers(0, 2**64, 3000, dtype=np.uint64)
    values[:4] = 0, 2**64 - 1, 2**63, 2**58 - 1
    packed = filters.collected_filter(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "own long"), 30)
    bits = len(packed).bit_length() + 2
    expected = np.zeros(1 << bits, bool)
    expected[(values >> np.uint64(64 - bits)).astype(np.int64)] = True
    assert (np.unpackbits(packed).astype(bool) == expected).all()
    assert filters.passes(packed, values).all()


def test_a_task_holds_bits_not_bytes():
    bits, values = 27, np.random.default_rng(6).integers(0, 2**64, 200_000, dtype=np.uint64)
    tracemalloc.start()
    out = list(filters._pieces(bits)(iter([pa.record_batch([pa.array(values.view(np.int64))], names=["h"])])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == filters.PIECES
    assert most < 64 << 20  # 16 MB of bits; a byte for each was 128 MB


def test_hashes_do_not_depend_on_stretches():
    said = [b"a", b"long" * 40_000, "größe".encode(), b"x" * 70_000, b"end"] + [b"w%d" % i for i in range(60_000)]
    whole = kernels.Words(kernels.Texts(pa.array([b" ".join(said).decode()])), kernels.BLANK)
    alone = kernels.Words(kernels.Texts(pa.array([x.decode() for x in said])), kernels.BLANK)
    assert (whole.hashes() == alone.hashes()).all()
    assert len(set(alone.hashes().tolist())) == len(said)
    assert all(len(x) <= kernels.HASHED for x in kernels._POWERS.values())
