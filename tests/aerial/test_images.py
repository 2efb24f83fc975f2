import numpy as np
import pytest

from aerolith import report
from aerolith.functions import geo
from aerolith.operators import matching, rectify
from aerolith.sources import images, models, store


def test_rectified_images_are_stored_and_read(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (12, 16, 3)).astype(np.uint8)
    poses = spark.createDataFrame([(i, 10.0 * i, -90.0, 0.0) for i in range(2)], "image_id long, yaw double, pitch double, roll double")
    pixels = spark.createDataFrame([(i, 12, 16, 3, bytearray(img.tobytes()), 16.0, 12.0) for i in range(2)], "image_id long, height int, width int, nChannels int, data binary, meta_width double, meta_height double")
    out = rectify.rectified(geo.with_rotation(poses).join(pixels, "image_id"), side=64)
    rows = out.collect()
    assert len(rows) == 2 and all(max(r.height, r.width) == 64 and len(r.mask) == r.height * r.width for r in rows)
    store.write_rectified(out, f"file://{tmp_path}")
    back = {r.origin.rpartition("/")[2]: r for r in images.read_pixels(spark, str(tmp_path)).collect()}
    assert set(back) == {"0_r.png", "0_rm.png", "1_r.png", "1_rm.png"}
    for r in rows:
        assert bytes(back[f"{r.image_id}_r.png"].data) == bytes(r.data) and bytes(back[f"{r.image_id}_rm.png"].data) == bytes(r.mask)
    with pytest.raises(ValueError):
        store.write_image(np.zeros((0, 0)), f"file://{tmp_path}/none.png")


def test_pluggable_matcher(spark):
    def nearest(k0, d0, k1, d1):
        s = d0 @ d1.T
        return np.column_stack([np.arange(len(d0)), s.argmax(axis=1)]), s.max(axis=1)

    rows = [(i, k, 0.1 * k, 0.2, [1.0 if c == (k + i) % 3 else 0.0 for c in range(3)]) for i in range(2) for k in range(3)]
    f = spark.createDataFrame(rows, "image_id long, feat_idx long, nx double, ny double, descriptor array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 9)], "img_lhs long, img_rhs long")
    got = matching.score_with(pairs, f, nearest).collect()
    assert sorted((r.lhs, r.rhs, r.score) for r in got) == [(0, 2, 1.0), (1, 0, 1.0), (2, 1, 1.0)]
    assert callable(models.OnnxPairMatcher("x"))


def test_progress_stays_in_range():
    p = report.Progress(5)
    assert [p.update(), p.update(9), p.update(-20), p.update(current=3), p.update(current=99)] == [1, 5, 0, 3, 5]
    p.reset(4, countdown=True)
    assert [p.current, p.update(), p.update(9)] == [4, 3, 0]
    p.rerun()
    assert p.current == 4 and str(p).endswith("4/4") and report.Progress(0).share == 1.0


def test_texts(spark):
    row = spark.createDataFrame([(1, 2, 120, 22.5, 114.0, 100.0)], "img_lhs long, img_rhs long, n_matches long, lat double, lon double, rel_alt double").select(report.pair_text().alias("p"), report.pose_text().alias("q")).first()
    assert row.p == "1 - 2: 120 matches" and row.q == "lat 22.500000, lon 114.000000, altitude 100.00"


def test_texts_of_poses_and_cameras(spark):
    df = spark.createDataFrame([(1.5, -90.0, 0.25, 3000.0, 2999.5, 2000.0, 1500.0)], "yaw double, pitch double, roll double, fx double, fy double, cx double, cy double")
    assert tuple(df.select(report.angle_text(), report.intrinsic_text()).first()) == ("yaw 1.50, pitch -90.00, roll 0.25", "fx 3000.00, fy 2999.50, cx 2000.00, cy 1500.00")
