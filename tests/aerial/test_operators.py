import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith import catalog
from aerolith.operators import adjust, features, matching, mosaic, neighbours, tracks, triangulate
from tests.conftest import SF


def brute_nearest(points, k):
    out = set()
    for i, x, y in points:
        order = sorted((round(((x - a) ** 2 + (y - b) ** 2) ** 0.5, 6), j) for j, a, b in points if j != i)
        out |= {(i, j, n + 1, d) for n, (d, j) in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered", "coincident", "few", "line"])
def test_nearest_equals_brute_force(spark, kind):
    rng = random.Random(4)
    points = {
        "spread": [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(120)],
        "clustered": [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(100)] + [(200 + i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(15)],
        "coincident": [(i, 1.0, 2.0) for i in range(60)] + [(100 + i, float(i), 5.0) for i in range(6)],
        "few": [(3, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)],
        "line": [(i, float(i * i), 0.0) for i in range(40)],
    }[kind]
    got = neighbours.nearest(spark.createDataFrame(points, "id long, x double, y double"), 5).collect()
    assert {tuple(r) for r in got} == brute_nearest(points, 5) and len(got) == len({tuple(r) for r in got})


def test_nearest_of_one_and_none(spark):
    for points in ([], [(1, 0.0, 0.0)]):
        assert neighbours.nearest(spark.createDataFrame(points, "id long, x double, y double")).count() == 0


def test_pairs_are_canonical_and_every_image_keeps_its_neighbours(spark):
    pairs = catalog.QUERIES["neighbor_pairs"](spark, SF).collect()
    assert all(r.img_lhs < r.img_rhs for r in pairs)
    degree = catalog.QUERIES["pair_degree"](spark, SF).collect()
    assert min(r.degree for r in degree) >= min(8, len(degree) - 1)


def matches(spark, rows):
    return spark.createDataFrame([(0, 1, *r) for r in rows], "img_lhs long, img_rhs long, lhs long, rhs long, score double")


def test_a_loser_has_no_second_choice(spark):
    got = matching.one_to_one(matches(spark, [(1, 7, 0.9), (2, 7, 0.8), (2, 8, 0.7), (3, 9, 0.5), (4, 9, 0.5)])).collect()
    assert sorted((r.lhs, r.rhs) for r in got) == [(1, 7), (3, 9)]


def test_pairs_with_exactly_the_threshold_are_valid(spark):
    for n, kept in ((99, 0), (100, 1)):
        assert matching.valid_pairs(matches(spark, [(i, i, 0.5) for i in range(n)])).count() == kept


def test_dictionary_gives_equal_points_one_id(spark):
    m = matches(spark, [(0, 0, 0.5), (1, 1, 0.5), (2, 2, 0.5)])
    near = float(np.nextafter(1.0, 2.0))
    points = [(0, 0, 1.0, 1.0), (0, 1, 1.0, 1.0), (0, 2, near, 1.0), (1, 0, 5.0, 5.0), (1, 1, 6.0, 5.0), (1, 2, 5.0, 5.0)]
    f = spark.createDataFrame(points, "image_id long, feat_idx long, x double, y double")
    ids = {(r.image_id, r.px, r.py): r.pnt_idx for r in matching.keypoint_dictionary(m, f).collect()}
    assert ids == {(0, 1.0, 1.0): 0, (0, near, 1.0): 1, (1, 5.0, 5.0): 0, (1, 6.0, 5.0): 1}
    assert sorted((r.pnt_lhs, r.pnt_rhs) for r in matching.encoded(m, f).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(150)] + [(500, 400), (400, 401), (401, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(151)} | {i: 400 for i in (400, 401, 500)}
    for parts in (1, 20):
        got = tracks.components(df.repartition(parts))
        assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)
    assert tracks.components(df.where("a < 0")).count() == 0


def brute_tracks(edges):
    cluster, out = {}, {}
    for e in edges:
        for n in e[:2]:
            cluster[n] = n
            out[n] = {n}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        p, q = cluster[a], cluster[b]
        if p != q and not {n // 1000 for n in out[p]} & {n // 1000 for n in out[q]}:
            out[p] |= out.pop(q)
            cluster.update(dict.fromkeys(out[p], p))
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("task_edges", [50_000, 5])
def test_conflict_free_tracks(spark, task_edges):
    rng = random.Random(9)
    pairs = {(min(p), max(p)) for p in ((rng.randrange(4) * 1000 + rng.randrange(6), rng.randrange(4) * 1000 + rng.randrange(6)) for _ in range(45)) if p[0] != p[1]}
    edges = [(a, b, rng.choice([0.5, 0.6, 0.7, rng.random()])) for a, b in sorted(pairs)]
    got = tracks.conflict_free_tracks(spark.createDataFrame(edges, "a long, b long, score double"), "CAST(floor(node / 1000) AS BIGINT)", task_edges).collect()
    found = {}
    for r in got:
        found.setdefault(r.track_id, set()).add(r.node)
    assert {frozenset(v) for v in found.values()} == brute_tracks(edges)
    assert all(len({n // 1000 for n in v}) == len(v) for v in found.values())


def rays(spark, rows):
    return spark.createDataFrame(rows, "track_id long, cx double, cy double, cz double, vx double, vy double, vz double")


def test_parallel_rays_are_not_usable_and_single_views_are_left_out(spark):
    got = {r.track_id: r for r in triangulate.linear(rays(spark, [(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)])).collect()}
    assert set(got) == {1} and not got[1].usable and got[1].X is None


def test_linear_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    data = [(t, *rng.normal(size=6).tolist()) for t in range(8) for _ in range(2 + t % 3)]
    for r in triangulate.linear(rays(spark, data)).collect():
        mine = np.array([d[1:] for d in data if d[0] == r.track_id])
        n = len(mine)
        a, b = np.zeros((3 * n, 3 + n)), np.zeros(3 * n)
        for i, row in enumerate(mine):
            a[3 * i : 3 * i + 3, :3], a[3 * i : 3 * i + 3, 3 + i], b[3 * i : 3 * i + 3] = -np.eye(3), row[3:], -row[:3]
        assert np.allclose([r.X, r.Y, r.Z], np.linalg.lstsq(a, b, rcond=None)[0][:3])


def test_shared_depth_equals_least_norm(spark):
    rng = np.random.default_rng(7)
    data = [(t, *rng.normal(size=6).tolist()) for t in range(6) for _ in range(3)]
    for r in triangulate.shared_depth(rays(spark, data)).collect():
        mine = np.array([d[1:] for d in data if d[0] == r.track_id])
        a = np.vstack([np.column_stack([-np.eye(3), v]) for v in mine[:, 3:]])
        assert np.allclose([r.X, r.Y, r.Z], np.linalg.lstsq(a, -mine[:, :3].ravel(), rcond=None)[0][:3])


def test_robust_points_resist_an_outlier():
    cam = np.array([[x, y, 100.0] for x, y in itertools.product((0, 20, 40), (0, 20, 40))], float)
    point = np.array([17.0, 12.0, 3.0])
    uv = 3000 * (point - cam)[:, :2] / (cam[:, 2:] - point[2])
    uv[0] += 400
    x, value, _ = triangulate.refine_points(point[None] + 1, np.zeros(9, int), cam, np.full((9, 2), 3000.0), uv, 200)
    assert np.abs(x[0] - point).max() < 0.05 and value[0] < 566


def survey_block(rng, noise=0.0):
    points = np.column_stack([rng.uniform(0, 60, (60, 2)), rng.uniform(0, 5, 60)])
    cams = [[0, 1, 0, 0, x, y, 100, 2000, 2000, 0, 0] for x in (10.0, 30.0, 50.0) for y in (10.0, 40.0)]
    truth = np.array(cams, float)
    seen = [(t, c, *(adjust.jacobians(truth[c : c + 1], points[t : t + 1], np.zeros((1, 2)))[0][0] + noise * rng.normal(size=2)).tolist()) for t in range(60) for c in range(6)]
    off = truth.copy()
    off[:, 4:6] += rng.normal(0, 0.2, (6, 2))
    return points, truth, off, seen


def frames(spark, off, points, seen):
    cameras = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(off)], adjust.CAMERA_SCHEMA)
    start = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "track_id long, X double, Y double, Z double")
    return cameras, start, spark.createDataFrame(seen, "track_id long, image_id long, u double, v double")


def test_bundle_reaches_the_noise(spark):
    """The loss falls with every step; without noise it vanishes, with outliers it ends near their own share."""
    rng = np.random.default_rng(8)
    points, _, off, seen = survey_block(rng)
    start = points + rng.normal(0, 0.1, points.shape)
    _, _, losses = adjust.bundle(*frames(spark, off, start, seen), turns=12)
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < 1e-3 < 1e3 < losses[0]
    points, truth, off, seen = survey_block(rng, 0.2)
    for k in range(0, 360, 45):
        seen[k] = (*seen[k][:2], seen[k][2] + 60, seen[k][3])
    at_truth = adjust.bundle(*frames(spark, truth, points, seen), turns=0)[2][0]
    _, _, losses = adjust.bundle(*frames(spark, off, start, seen), turns=12)
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < at_truth


def test_reduced_system_equals_the_whole_one(spark):
    """One damped step against the dense normal equations of all cameras and points."""
    rng = np.random.default_rng(9)
    points, _, off, seen = survey_block(rng, 0.5)
    points = points + rng.normal(0, 0.05, points.shape)
    seen = [s for s in seen if rng.random() < 0.7]
    t, c, uv = np.array([s[0] for s in seen]), np.array([s[1] for s in seen]), np.array([s[2:] for s in seen])
    res, jc, jp, _ = adjust.jacobians(off[c], points[t], uv)
    w, loss = adjust._weights(res)
    jac = np.zeros((2 * len(seen), 60 + 180))
    for k in range(len(seen)):
        jac[2 * k : 2 * k + 2, 10 * c[k] : 10 * c[k] + 10], jac[2 * k : 2 * k + 2, 60 + 3 * t[k] : 63 + 3 * t[k]] = jc[k], jp[k]
    h, g = jac.T @ (np.repeat(w, 2)[:, None] * jac), jac.T @ (np.repeat(w, 2) * res.ravel())
    damping = 1e-2
    extra = damping * np.diag(h) + np.concatenate([np.full(60, 1e-9), np.full(180, 1e-12)])
    want = np.linalg.solve(h + np.diag(extra), -g)
    cameras, start, rows = frames(spark, off, points, seen)
    views = rows.groupBy("track_id").agg(F.collect_list(F.struct("image_id", "u", "v")).alias("views"))
    packed = start.join(views, "track_id", "left")
    ids = np.arange(6)
    blocks = packed.mapInArrow(adjust._assembled(ids, off, damping), "i long, j long, s array<double>").repartition("i", "j").mapInArrow(adjust._summed, "i long, j long, s array<double>")
    old = adjust.GRADIENT_SHARE, adjust.GRADIENT_STEPS
    adjust.GRADIENT_SHARE, adjust.GRADIENT_STEPS = 1e-12, 300
    try:
        step = adjust._camera_step(blocks.cache(), 6, damping)
    finally:
        adjust.GRADIENT_SHARE, adjust.GRADIENT_STEPS = old
    scale = 1 / np.sqrt(extra)
    assert np.allclose(step.ravel() / scale[:60], want[:60] / scale[:60], atol=1e-4 * np.abs(want[:60] / scale[:60]).max())


def test_bundle_keeps_what_is_not_seen(spark):
    """Cameras and points without an observation stay; a point in a camera's plane spoils nothing."""
    rng = np.random.default_rng(10)
    points, _, off, seen = survey_block(rng)
    off = np.vstack([off, [[0, 1, 0, 0, 500, 500, 100, 2000, 2000, 0, 0]]])
    points = np.vstack([points, [[900.0, 900.0, 0.0]], [[30.0, 30.0, 100.0]]])
    seen = [*seen, (61, 0, 5.0, 5.0), (61, 1, 6.0, 5.0), (3, 77, 1.0, 1.0)]
    cameras, moved, losses = adjust.bundle(*frames(spark, off, points, seen), turns=4)
    cams, moved = {r.image_id: r for r in cameras.collect()}, {r.track_id: r for r in moved.collect()}
    assert set(cams) == set(range(7)) and set(moved) == set(range(62))
    assert tuple(cams[6])[1:] == tuple(off[6]) and tuple(moved[60])[1:] == (900.0, 900.0, 0.0)
    assert np.isfinite(losses).all() and all(np.isfinite(tuple(r)[1:]).all() for r in [*cams.values(), *moved.values()])
    assert losses[-1] < losses[0]


def test_camera_derivatives():
    rng = np.random.default_rng(9)
    cam = np.array([[*adjust.turned(np.array([[0.0, 1, 0, 0]]), rng.normal(0, 0.1, (1, 3)))[0], 3, 4, 90, 1500, 1600, 5, 6]])
    p, uv = rng.uniform(0, 9, (1, 3)), np.zeros((1, 2))
    res, by_camera, by_point, _ = adjust.jacobians(cam, p, uv)
    for k in range(10):
        step = np.zeros((1, 10))
        step[0, k] = 1e-6
        other = cam.copy()
        other[:, :4] = adjust.turned(cam[:, :4], step[:, :3])
        other[:, 4:] += step[:, 3:]
        assert np.allclose((adjust.jacobians(other, p, uv)[0] - res) / 1e-6, by_camera[:, :, k], rtol=1e-3, atol=1e-3)
    for k in range(3):
        q = p.copy()
        q[0, k] += 1e-6
        assert np.allclose((adjust.jacobians(cam, q, uv)[0] - res) / 1e-6, by_point[:, :, k], rtol=1e-3, atol=1e-3)


def test_mosaic_of_shifted_tiles():
    rng = np.random.default_rng(10)
    scene = rng.integers(0, 256, (40, 90, 3)).astype(np.uint8)
    nodes = {i: (scene[:, 15 * i : 15 * i + 30].copy(), np.full((40, 30), 255, np.uint8)) for i in range(5)}
    shift = np.array([[1, 0, -15], [0, 1, 0], [0, 0, 1]], float)
    img, mask = mosaic.Mosaic(nodes, {(i, i + 1): shift for i in range(4)}).run()
    assert img.shape == scene.shape and mask.all() and np.array_equal(img, scene)
    with pytest.raises(ValueError):
        mosaic.Mosaic({}, {})


def test_mosaic_in_tasks_equals_mosaic_in_memory(spark, tmp_path):
    """A ring of turned and shifted tiles; the partial mosaics and their masks stand beside the nodes."""
    rng = np.random.default_rng(11)
    nodes = {i: (rng.integers(0, 256, (20, 24, 3)).astype(np.uint8), np.full((20, 24), 255, np.uint8)) for i in range(6)}
    turn = lambda a, x, y: np.array([[np.cos(a), -np.sin(a), x], [np.sin(a), np.cos(a), y], [0, 0, 1]])
    edges = {(0, 1): turn(0.1, -9, 2), (1, 2): turn(0.0, -8, 1), (2, 3): turn(-0.2, -7, 0), (3, 4): turn(0.1, -9, -3), (4, 5): turn(0.05, -10, 1), (1, 4): turn(0.0, -20, 1)}
    want, mask = mosaic.Mosaic(nodes, edges).run()
    rows = [(i, 20, 24, 3, bytearray(img.tobytes()), bytearray(m.tobytes())) for i, (img, m) in nodes.items()]
    kept = mosaic.Stored(spark, str(tmp_path))
    ids = kept.put(spark.createDataFrame(rows, "image_id long, height int, width int, nChannels int, data binary, mask binary").repartition(3))
    assert ids == list(range(6))
    got, got_mask = mosaic.Mosaic(kept, edges, ids).run()
    assert np.array_equal(got, want) and np.array_equal(got_mask, mask)
    assert {p.name for p in tmp_path.glob("p0-i6*")} == {"p0-i6.png", "p0-i6_mask.png"}


def test_features(spark):
    rows = [(1, i, float(i), 5.0, s) for i, s in enumerate([0.04, 0.9, 0.5, 0.9, 0.05])]
    f = spark.createDataFrame(rows, "image_id long, feat_idx int, x double, y double, score double")
    assert [r.feat_idx for r in features.strongest(f, top=3).orderBy("rank").collect()] == [1, 3, 2]
    img = np.zeros((60, 60, 3), np.uint8)
    img[20:40, 20:40] = 255
    points, scores, desc = features.CornerDetector()(img)
    corners = {(x, y) for x in (19, 20, 39, 40) for y in (19, 20, 39, 40)}
    assert len(points) >= 4 and scores.max() == 1 and desc.shape[1] == 64
    assert all(min(abs(x - a) + abs(y - b) for a, b in corners) <= 2 for x, y in points)
    table = spark.createDataFrame(pd.DataFrame({"image_id": [7], "height": [60], "width": [60], "nChannels": [3], "data": [img.tobytes()]}))
    assert features.extract(table).where(F.col("image_id") == 7).count() == len(points)


def test_refined_points_leave_the_arrays(monkeypatch):
    """One point that needs many steps doesn't make the others, which are done, be solved for again."""
    n, views = 200, 6
    rng = np.random.default_rng(3)
    places, track = rng.uniform(0, 50, (n, 3)) * [1, 1, 0.1], np.repeat(np.arange(n), views)
    centre = np.column_stack([places[track][:, :2] + rng.uniform(-30, 30, (n * views, 2)), np.full(n * views, 120.0)])
    d, focal = places[track] - centre, np.full((n * views, 2), 3000.0)
    uv = focal * d[:, :2] / -d[:, 2:] + rng.uniform(-1.5, 1.5, (n * views, 2))
    uv[::11] += 40
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: (solved.append(len(a)), solve(a, b))[1])
    found, cost, steps = triangulate.refine_points(places + 0.05, track, centre, focal, uv, 1000)
    assert solved[0] == n and solved[-1] < n / 2 and (steps > 0).all()
    alone = triangulate.refine_points(places[:1] + 0.05, track[:views], centre[:views], focal[:views], uv[:views], 1000)
    assert np.allclose(found[0], alone[0][0]) and np.isclose(cost[0], alone[1][0])


def test_adjustment_linearises_few_views_at_a_time(monkeypatch):
    """A batch of many tracks is taken in pieces whose sums are those of the whole; a track with more views is alone."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    tracks_, cams = 60, 7
    cameras = np.column_stack([np.tile([0.0, 1, 0, 0], (cams, 1)), rng.uniform(0, 50, (cams, 2)), np.full(cams, 120.0), np.full((cams, 2), 3000.0), np.zeros((cams, 2))])
    views = [[{"image_id": i, "u": float(u), "v": float(v)} for i, (u, v) in enumerate(rng.normal(size=(1 + k % cams, 2)))] for k in range(tracks_)]
    columns = [pa.array(range(tracks_)), *(pa.array(c) for c in rng.uniform(0, 50, (3, tracks_)))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(views, pa.list_(pa.struct([("image_id", pa.int64()), ("u", pa.float64()), ("v", pa.float64())])))], names=["track_id", *"XYZ", "views"])
    run, seen = adjust._assembled(np.arange(cams), cameras, 1e-4), []
    linearised = adjust.jacobians
    monkeypatch.setattr(adjust, "jacobians", lambda cam, *rest: (seen.append(len(cam)), linearised(cam, *rest))[1])
    sums = {}
    for limit in (10**6, 5):
        monkeypatch.setattr(adjust, "VIEWS", limit)
        seen.clear()
        blocks = [b for out in run(iter([batch.slice(0, 30), batch.slice(30)])) for b in out.to_pylist()]
        sums[limit] = {(b["i"], b["j"]): np.array(b["s"]) for b in blocks}
    assert max(seen) == cams and sum(seen) == sum(map(len, views)) and all(n <= 5 or n in (6, 7) for n in seen)
    assert sums[5].keys() == sums[10**6].keys() and all(np.allclose(sums[5][k], sums[10**6][k]) for k in sums[5])


def test_points_of_one_place_are_asked_for_once(spark, monkeypatch):
    """Many points in few places: what is kept on the way grows with the places, not the points."""
    kept, write = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: (t := write(df, name), kept.append((name, t.count())))[0])
    rows = [(i, float(i % 5), float(i % 3)) for i in range(600)]
    got = neighbours.nearest(spark.createDataFrame(rows, "id long, x double, y double"), 4).collect()
    assert max(n for name, n in kept if name == "nearest") <= 15
    near = lambda i: sorted((round(((rows[j][1] - rows[i][1]) ** 2 + (rows[j][2] - rows[i][2]) ** 2) ** 0.5, 6), j) for j in range(600) if j != i)[:4]
    for i in (0, 7, 599):
        assert sorted((r.rank, r.distance, r.neighbour_id) for r in got if r.id == i) == [(k + 1, *q) for k, q in enumerate(near(i))]
    assert len(got) == 2400


@pytest.mark.parametrize("name", ["polygon_iou", "polygon_iou_turned"])
def test_polygons_are_clipped_on_all_cores(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
