import os

import numpy as np
import pytest

from mosaiq.matrix import TiledMatrix
from mosaiq.sources import columnmajor, storage


@pytest.mark.parametrize("dtype", ["d", "z", "s"])
def test_column_major_files_with_a_leading_dimension(spark, tmp_path, dtype):
    rng = np.random.default_rng(1)
    a = (rng.standard_normal((13, 11)) + (1j if dtype == "z" else 0) * rng.standard_normal((13, 11))).astype({"d": float, "z": complex, "s": np.float32}[dtype])
    m = TiledMatrix.from_numpy(spark, a, 5, 4)
    path = str(tmp_path / "raw")
    columnmajor.write(m, path, 17)
    assert sorted(os.listdir(path)) == [f"columns-{k:08d}.bin" for k in range(3)]
    back = columnmajor.read(spark, path, 13, 11, 6, 4, 17, dtype)
    assert np.array_equal(back.to_numpy(), a) and back.tiles.rdd.getNumPartitions() == 3
    raw = np.concatenate([np.fromfile(f"{path}/{f}", a.dtype) for f in sorted(os.listdir(path))])
    assert np.array_equal(raw.reshape(11, 17)[:, :13].T, a)
    with pytest.raises(Exception, match="there already"):
        columnmajor.write(m, path, 17)


def test_a_single_raw_file(spark, tmp_path):
    a = np.arange(35.0).reshape(5, 7, order="F")
    whole = np.full((9, 7), -9.9, order="F")
    whole[2:7] = a
    whole.ravel(order="F")[:-2].tofile(tmp_path / "file.bin")  # nothing stands behind the last column
    back = columnmajor.read(spark, str(tmp_path / "file.bin"), 5, 7, 2, 3, 9, offset=2)
    assert np.array_equal(back.to_numpy(), a)
    assert np.array_equal(TiledMatrix.from_column_major(spark, whole.ravel(order="F")[2:], 5, 7, 2, 3, 9).to_numpy(), a)
    with pytest.raises(Exception, match="ends before"):
        columnmajor.read(spark, str(tmp_path / "file.bin"), 5, 9, 2, 3, 9).tiles.collect()
    with pytest.raises(ValueError):
        TiledMatrix.from_column_major(spark, whole.ravel(), 5, 7, 2, 3, 4)


def test_text_files_and_ranges_of_zeros(spark, tmp_path):
    a = np.round(np.random.default_rng(2).standard_normal((11, 6)), 3)
    a[4:8] = 0
    m = TiledMatrix.from_numpy(spark, a, 4, 4)
    m = m.cleared((1, 0), (2, 2))  # a row of tiles that isn't there
    storage.write_csv(m, str(tmp_path / "csv"))
    parts = sorted(f for f in os.listdir(tmp_path / "csv") if f.startswith("part"))
    assert "".join((tmp_path / "csv" / f).read_text() for f in parts) == storage.to_csv(m)
    assert np.array_equal(storage.read_csv(spark, str(tmp_path / "csv"), 3, 5).to_numpy(), a)
    zeros = a.copy()
    zeros[:8, 4:] = 0
    assert np.array_equal(TiledMatrix.from_numpy(spark, a, 4, 4).cleared((0, 1), (2, 2)).to_numpy(), zeros)
    assert m.cleared().to_numpy().sum() == 0
