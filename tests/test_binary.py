import struct

import numpy as np
import pytest

from orrery.sources import binary as B


def walk(rng, frames, atoms, size=0.05):
    """Chains whose atoms lie near one another, with jumps."""
    step = rng.normal(0, size, (frames, atoms, 3))
    step[:, :: max(3, atoms // 4)] += rng.normal(0, 2, (frames, len(range(0, atoms, max(3, atoms // 4))), 3))
    return step.cumsum(1)


@pytest.mark.parametrize("atoms", [1, 9, 10, 11, 50, 333])
def test_xtc_codec(atoms):
    rng = np.random.default_rng(atoms)
    xyz = walk(rng, 40, atoms)
    xyz[3] *= 0.01
    xyz[5] = 0.25
    raw = [B.encode_xtc(x, np.arange(9), i, i * 0.5) for i, x in enumerate(xyz)]
    got, cells = B.decode_xtc(raw)
    want = xyz.astype(np.float32) if atoms <= 9 else np.rint(xyz * 1000) / 1000
    assert np.allclose(got, want, atol=1e-9) and (cells == np.arange(9)).all()


def test_xtc_wide_coordinates_and_head():
    xyz = np.random.default_rng(1).normal(0, 9000, (30, 20, 3))
    got, _ = B.decode_xtc([B.encode_xtc(x, np.eye(3), i, 0) for i, x in enumerate(xyz)])
    assert np.allclose(got, np.rint(xyz * 1000) / 1000)
    raw = B.encode_xtc(xyz[0], np.eye(3), 7, 3.5)
    assert struct.unpack(">iiif", raw[:16]) == (1995, 20, 7, 3.5) and struct.unpack(">i", raw[88:92])[0] <= len(raw) - 92 and len(raw) % 4 == 0
    # The later version of the head has a length of 64 bits.
    late = struct.pack(">i", 2023) + raw[4:88] + struct.pack(">q", struct.unpack(">i", raw[88:92])[0]) + raw[92:]
    assert np.allclose(B.decode_xtc([late])[0], np.rint(xyz[:1] * 1000) / 1000)


def table(spark, xyz):
    rows = [(f, float(f) / 4, a, *map(float, xyz[f, a])) for f in range(xyz.shape[0]) for a in range(xyz.shape[1])]
    return spark.createDataFrame(rows, "frame long, time_ps double, atom int, x double, y double, z double")


@pytest.mark.parametrize("kind", ["xtc", "dcd"])
def test_files(spark, tmp_path, kind):
    xyz = walk(np.random.default_rng(2), 60, 15)
    frames = table(spark, xyz)
    (B.write_xtc if kind == "xtc" else B.write_dcd)(frames, f"{tmp_path}/t")
    index = B.frame_index(spark, f"{tmp_path}/t/*.{kind}")
    assert [r.frame for r in index.orderBy("frame").collect()] == list(range(60)) and index.agg({"n_atoms": "max"}).first()[0] == 15
    got = B.read_frames(index, 5, 50, 7, keep=[3, 14, 99]).orderBy("frame", "atom").collect()
    assert [(r.frame, r.atom) for r in got] == [(f, a) for f in range(5, 50, 7) for a in (3, 14)]
    assert np.allclose([[r.x, r.y, r.z] for r in got], [xyz[f, a] for f in range(5, 50, 7) for a in (3, 14)], atol=6e-4)
    assert [r.time_ps for r in got[::2]] == pytest.approx([f / 4 if kind == "xtc" else f for f in range(5, 50, 7)], rel=1e-6)
    assert B.read_frames(index, 100).count() == 0 and B.load_binary(spark, f"{tmp_path}/t", 58, 900).count() == 30
    twice = B.frame_index(spark, [f"{tmp_path}/t", f"{tmp_path}/t"])
    assert twice.agg({"frame": "max"}).first()[0] == 119


def test_only_chosen_frames_are_read(spark, tmp_path, monkeypatch):
    """A damaged frame that the stride leaves out does no harm."""
    xyz = walk(np.random.default_rng(3), 6, 30)
    raw = [B.encode_xtc(x, np.eye(3), i, i) for i, x in enumerate(xyz)]
    spoilt = raw[1][:56] + b"\xff" * 4 + raw[1][60:]
    (tmp_path / "a.xtc").write_bytes(raw[0] + spoilt + b"".join(raw[2:]))
    got = B.load_binary(spark, f"{tmp_path}/a.xtc", 0, None, 2).orderBy("frame", "atom").collect()
    assert np.allclose(np.array([[r.x, r.y, r.z] for r in got]).reshape(3, 30, 3), np.rint(xyz[::2] * 1000) / 1000)


def test_bad_files_and_ranges(spark, tmp_path):
    good = B.encode_xtc(np.zeros((12, 3)), np.eye(3), 0, 0)
    for name, data in (("cut.xtc", good + good[:-4]), ("head.xtc", good + good[:30]), ("other.xtc", b"x" * 200), ("other.dcd", b"y" * 200)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="file ends|no frame|not a DCD"):
            B.frame_index(spark, f"{tmp_path}/{name}").collect()
    (tmp_path / "good.xtc").write_bytes(good)
    index = B.frame_index(spark, f"{tmp_path}/good.xtc")
    for bad in ({"start": -1}, {"stride": 0}, {"start": 3, "stop": 3}):
        with pytest.raises(ValueError):
            B.read_frames(index, **bad)
    with pytest.raises(Exception):
        B.frame_index(spark, f"{tmp_path}/none*.xtc")


def test_dcd_cell():
    told = b"CORD" + struct.pack("<9if10i", 1, 0, 1, *[0] * 6, 1.0, 1, *[0] * 8, 24)
    head = struct.pack("<i", 84) + told + struct.pack("<i", 84) + struct.pack("<ii80si", 84, 1, b"", 84) + struct.pack("<iii", 4, 2, 4)
    frame = struct.pack("<i6di", 48, 20.0, 90.0, 30.0, 90.0, 60.0, 40.0, 48)
    for k in range(3):
        frame += struct.pack("<i2fi", 8, 10.0 + k, 20.0, 8)
    xyz, cells = B.decode_dcd([frame], B.dcd_head(head + frame))
    assert np.allclose(xyz, [[[1, 1.1, 1.2], [2, 2, 2]]])
    assert np.allclose(cells, [[2, 0, 0, 0, 3, 0, 0, 2, 12**0.5]])
