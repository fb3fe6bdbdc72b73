import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidewheel.sources import lerobot, zarr


def _store(root, name, x, chunks, kind=None, order="C", absent=()):
    folder = root / name
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": x.shape, "chunks": chunks, "dtype": x.dtype.str, "fill_value": 7, "order": order, "filters": None, "compressor": kind and {"id": kind}}))
    pack = {
        None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress,
        "lz4": lambda b: struct.pack("<I", len(b)) + pa.compress(b, codec="lz4_raw", asbytes=True), "blosc": bytes,
    }[kind]
    for at in np.ndindex(*(-(-n // c) for n, c in zip(x.shape, chunks))):
        part = x[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))]
        full = np.zeros(chunks, x.dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        if at not in absent:
            (folder / ".".join(map(str, at))).write_bytes(pack(full.tobytes(order)))


@pytest.mark.parametrize("kind,order", [(None, "C"), ("zlib", "F"), ("gzip", "C"), ("zstd", "C"), ("lz4", "F")])
def test_frames_equal_the_arrays(spark, tmp_path, kind, order):
    state, action = np.arange(70, dtype="<f4").reshape(10, 7), np.arange(20, dtype="<f8").reshape(10, 2)
    (tmp_path / ".zgroup").write_text("{}")
    _store(tmp_path, "data/robot_state", state, [4, 3], kind, order)
    _store(tmp_path, "data/action", action, [3, 2], kind, order, absent=[(1, 0)])
    _store(tmp_path, "data/camera0_rgb", np.zeros((10, 2, 2, 3), "u1"), [1, 2, 2, 3])
    _store(tmp_path, "meta/episode_ends", np.array([4, 10], "<i8"), [2])
    root = f"file://{tmp_path}"
    assert lerobot.detect_format(spark, root) == "zarr"
    want = action.copy()
    want[3:6] = 7
    got = zarr.read_frames(spark, root).orderBy("episode_id", "frame_index").collect()
    assert [(r["episode_id"], r["frame_index"]) for r in got] == [("0", i) for i in range(4)] + [("1", i) for i in range(6)]
    assert np.array_equal([r["state"] for r in got], state) and np.array_equal([r["action"] for r in got], want)


def test_store_without_ends_is_one_episode(spark, tmp_path):
    _store(tmp_path, "action", np.arange(5, dtype="<i4"), [2])
    got = zarr.read_frames(spark, f"file://{tmp_path}").orderBy("frame_index").collect()
    assert [(r["episode_id"], r["frame_index"], r["action"], r["state"]) for r in got] == [("0", i, [float(i)], None) for i in range(5)]


def test_unknown_compressor_raises(spark, tmp_path):
    _store(tmp_path, "action", np.arange(5, dtype="<i4"), [2], "blosc")
    with pytest.raises(Exception, match="blosc"):
        zarr.read_frames(spark, f"file://{tmp_path}").collect()
