import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo, mat, polygon, raster
from aerolith.runtime import upper_medians


def one(spark, columns):
    return [float(x) for x in spark.range(1).select(*(mat.num(c).alias(f"c{i}") for i, c in enumerate(columns))).first()]


def flat(m):
    return [x for row in m for x in row]


def test_matrix_algebra(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    ca, cb = ([[F.lit(float(x)) for x in row] for row in m] for m in (a, b))
    assert np.allclose(one(spark, flat(mat.mul(ca, cb))), (a @ b).ravel())
    assert np.allclose(one(spark, flat(mat.inverse(ca))), np.linalg.inv(a).ravel())
    x, d = mat.solve(ca, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    assert np.allclose(one(spark, [*x, d]), [*np.linalg.solve(a, [1, 2, 3]), np.linalg.det(a)])
    assert mat.mul([[0, 1], [1, 0]], [[2, 3], [4, 5]]) == [[4, 5], [2, 3]]


@pytest.mark.parametrize("angles", [(0, 0, 0), (30, -85, 2), (-170, -90, 0), (90, 45, -60)])
def test_pose_is_a_rotation_and_its_quaternion_returns_it(spark, angles):
    r = geo.world_to_camera(*(F.lit(float(a)) for a in angles))
    m = np.array(one(spark, flat(r))).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
    q = one(spark, mat.canonical(mat.quaternion([[F.lit(float(x)) for x in row] for row in m])))
    assert next(v for v in q if abs(v) > 1e-6) > 0
    assert np.allclose(one(spark, flat(mat.rotation([F.lit(v) for v in q]))), m.ravel(), atol=1e-7)


@pytest.mark.parametrize("angles", [(177, -88, 3), (-180, -82, 0), (-177, -87, -3)])
def test_quaternion_of_a_half_turn_has_the_sign_of_its_first_entry(spark, angles):
    r = geo.world_to_camera(*(F.lit(float(a)) for a in angles))
    raw, q = one(spark, mat.quaternion(r)), one(spark, mat.canonical(mat.quaternion(r)))
    assert 0 < abs(raw[0]) < 1e-6 and q == [v * np.sign(raw[0]) for v in raw]


@pytest.mark.parametrize(("values", "median"), [([5], 5), ([1, 2], 2), ([4, 1, 3, 2], 3), ([5, 1, 4, 2, 3], 3)])
def test_upper_median(spark, values, median):
    df = spark.createDataFrame([(float(v), -float(v), None) for v in [*values]], "v double, w double, x double")
    other = -sorted(values)[(len(values) - 1) // 2]
    assert upper_medians(df.repartition(3), ["v", "x", "w"]) == [median, None, other]
    assert upper_medians(df.where("v < 0"), ["v"]) == [None]


def test_normalise_and_back(spark):
    p, w, h = F.lit(123.0), F.lit(4000.0), F.lit(3000.0)
    assert np.allclose(one(spark, [geo.denormalise(geo.normalise(p, w, w, h), w, w, h)]), [123])


def test_small_functions(spark):
    v = lambda x: F.lit(float(x))
    assert one(spark, [geo.abs_ceil(v(1.2)), geo.abs_ceil(v(-1.2)), geo.abs_ceil(v(2)), geo.huber(v(0.25)), geo.huber(v(9))]) == [2, -2, 2, 0.25, 5]
    assert one(spark, geo.decimated(v(4000), v(3000))) == [1024, 768] and one(spark, geo.decimated(v(800), v(600))) == [800, 600]
    assert spark.range(1).select(geo.no_distortion()).first()[0] == [0.0] * 5


def test_polygons(spark):
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    moved = square + 1
    assert polygon.plain_area(polygon.clip(square, moved)) == 1
    assert polygon.plain_area(polygon.clip(square[::-1], moved[::-1])) == 1
    assert polygon.plain_area(polygon.clip(square, square + 5)) == 0
    assert polygon.plain_convex(square) and not polygon.plain_convex(np.array([(0, 0), (2, 0), (0.5, 0.5), (0, 2)], float))
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.normal(size=(3, 2))
        inside = polygon.clip(t, square)
        xs, ys = (rng.uniform(0, 2, 20000) for _ in range(2))
        sign = [(t[(i + 1) % 3][0] - t[i][0]) * (ys - t[i][1]) - (t[(i + 1) % 3][1] - t[i][1]) * (xs - t[i][0]) for i in range(3)]
        share = (np.all([s >= 0 for s in sign], axis=0) | np.all([s <= 0 for s in sign], axis=0)).mean()
        assert abs(polygon.plain_area(inside) - 4 * share) < 0.1


def test_raster():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert np.array_equal(raster.warp(img, np.eye(3), 60, 40), img)
    shift = np.array([[1, 0, 3], [0, 1, 2], [0, 0, 1]], float)
    moved = raster.warp(img, shift, 63, 42)
    assert np.array_equal(moved[2:, 3:], img) and not moved[:2].any()
    assert np.array_equal(raster.warp(img, shift, 63, 42, cubic=False), moved)
    assert raster.decimate(np.zeros((1, 2000), np.uint8)).shape == (1, 1024)
    assert raster.decimate(img).shape == img.shape
    assert np.isclose(raster.grey(np.array([[[0, 0, 255]]], np.uint8))[0, 0], 0.299)
    assert raster.planar(img).shape == (3, 40, 60) and np.isclose(raster.planar(img)[0, 0, 0], img[0, 0, 2] / 255)
    mask = raster.frame_mask(9, 7)
    assert mask[2:-2, 2:-2].all() and mask.sum() == 255 * 5 * 3
    with pytest.raises(ValueError):
        raster.frame_mask(4, 9)
    src, dst = rng.uniform(0, 9, (4, 2)), rng.uniform(0, 9, (4, 2))
    assert np.allclose(raster.transform_points(raster.homography(src, dst), src), dst)


def test_rectify_and_blend():
    img = np.full((30, 40, 3), 100, np.uint8)
    out, mask, _ = raster.rectify(img, 40, 30, np.eye(3), side=80)
    assert max(out.shape[:2]) == 80 and out.shape[:2] == mask.shape and set(np.unique(mask)) <= {0, 255}
    base, new = np.full((4, 4, 3), 10, np.uint8), np.full((4, 4, 3), 21, np.uint8)
    left, right = np.zeros((4, 4), np.uint8), np.zeros((4, 4), np.uint8)
    left[:, :3], right[:, 2:] = 255, 255
    img, mask = raster.blend(base, left, new, right)
    assert [int(v) for v in img[0, :, 0]] == [10, 10, 16, 21] and mask.all()
