import os

import numpy as np
import pytest

from cellgauge.operators import neighbours
from cellgauge.sources import arrays, raw


@pytest.fixture
def folder(tmp_path):
    draw = np.random.default_rng(1)
    made = {f"F{k}.f32": draw.normal(size=(7, 11, 13)).astype("float32") for k in range(3)}
    for name, x in made.items():
        (tmp_path / name).write_bytes(x.tobytes())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    return tmp_path, made


def test_cells_of_byte_ranges(spark, folder):
    path, made = folder
    df = arrays.read_fields(spark, "raw_cells", path=str(path), dims=[7, 11, 13], cells_per_task=100)
    assert df.rdd.getNumPartitions() == 3 * 11
    rows = df.collect()
    assert len(rows) == 3 * 1001
    for name, x in made.items():
        own = sorted((r["idx"], r["v"]) for r in rows if r["field_id"] == name)
        assert [i for i, _ in own] == list(range(1001)) and [v for _, v in own] == x.ravel().astype(float).tolist()


def test_a_filter_leaves_files_out(spark, folder):
    path, _ = folder
    named = raw.read_raw_cells(spark, str(path), [7, 11, 13], fields=["F1.f32", "F9.f32"])
    assert named.rdd.getNumPartitions() == 1 and named.where("field_id = 'F1.f32'").count() == named.count() == 1001
    assert raw.read_raw_cells(spark, str(path), [7, 11, 13], fields=[]).count() == 0
    assert raw.read_raw_cells(spark, str(path), [7, 11, 13]).where("field_id = 'F2.f32'").count() == 1001
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = raw.read_raw_cells(spark, f"file://{path}", [7, 11, 13]).where("field_id in ('F1.f32', 'F9.f32') and idx < 5")
        assert df.rdd.getNumPartitions() == 1 and sorted(r["idx"] for r in df.collect()) == [0, 1, 2, 3, 4]
        assert raw.read_raw_cells(spark, str(path), [7, 11, 13]).where("field_id = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_features_of_files_equal_those_of_packed_files(spark, folder):
    path, _ = folder
    dims = [7, 11, 13]
    a, b = (neighbours.neighbour_features(c, dims).orderBy("field_id").collect() for c in (raw.read_raw_cells(spark, str(path), dims, cells_per_task=300), arrays.unpack(arrays.read_raw(spark, f"{path}/F*.f32", dims))))
    assert a == b and len(a) == 3


@pytest.mark.parametrize("dims,dtype,said", [([7, 11, 12], "float32", "has 4004 bytes"), ([7, 11, 13], "float64", "has 4004 bytes"), ([], "float32", "needs dims"), ([0], "float32", "needs dims"), ([7], "text", "no dtype")])
def test_what_does_not_fit_is_an_error(spark, folder, dims, dtype, said):
    with pytest.raises(Exception, match=said):
        raw.read_raw_cells(spark, str(folder[0]), dims, dtype, glob="*.f32").count()


def test_no_files_and_one_long_file(spark, tmp_path):
    assert raw.read_raw_cells(spark, str(tmp_path), [5]).count() == 0
    with pytest.raises(Exception, match="missing"):
        raw.read_raw_cells(spark, str(tmp_path / "missing"), [5]).count()
    # Longer than one row of bytes can be; a sparse file takes no room.
    n = (1 << 31) + 4096
    with open(tmp_path / "long.u8", "wb") as f:
        os.truncate(f.fileno(), n)
    df = raw.read_raw_cells(spark, str(tmp_path), [n], "uint8", cells_per_task=1 << 26)
    assert df.rdd.getNumPartitions() == -(-n // (1 << 26))
    r = raw.RawReader({"path": str(tmp_path), "dims": str(n), "dtype": "uint8", "cells_per_task": 1 << 26})
    last = list(r.read(r.partitions()[-1]))
    assert sum(len(b) for b in last) == 4096 and last[-1].column(1)[-1].as_py() == n - 1
