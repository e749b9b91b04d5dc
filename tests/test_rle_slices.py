"""A task works on slices of a batch."""

import pyarrow as pa

from rasterflow.operators import rle


def test_rle_batches_are_cut_by_their_bytes():
    n, data = 3000, b"\x00\xff" + bytes(range(256)) + b"\x00\x01"
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([0] * n), pa.array([False] * n), pa.array([data] * n, pa.binary()), pa.array([0] * n)], ["image_id", "chunk", "nibbles", "data", "state"]
    )
    most = rle.HELD // (len(data) + 8 * (rle.END + 1)) + 1
    for read in (rle._maps, rle._chunk_runs):
        got = list(read([batch, batch.slice(0, 0)]))
        assert len(got) > 1 and max(b.num_rows for b in got) <= most
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(n))
