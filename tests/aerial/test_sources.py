import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import raster
from aerolith.operators import adjust, features, matching
from aerolith.plans import survey
from aerolith.sources import fixtures, images, models, store
from aerolith.streaming import ingest
from tests.aerial import onnx_file

VALUES = {"GimbalYawDegree": "+12.50", "GimbalPitchDegree": "-90.0", "GimbalRollDegree": "-0.0", "GpsLatitude": "22.5", "GpsLongitude": "114.1", "RelativeAltitude": "+100.1", "AbsoluteAltitude": "+135.0"}


def exif(width=4000, height=3000):
    return fixtures.exif(width, height, (45, 10), 24)


def jpeg(values=VALUES, with_exif=True):
    xmp = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:d="http://d/" ' + " ".join(f'd:{k}="{v}"' for k, v in values.items()) + "/></rdf:RDF></x:xmpmeta>"
    out = b"\xff\xd8"
    for body in ([exif()] if with_exif else []) + [b"http://ns.adobe.com/xap/1.0/\0" + xmp.encode()]:
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xd9"


def test_metadata():
    got = images.metadata_of(jpeg())
    assert got == {"yaw": 12.5, "pitch": -90.0, "roll": 0.0, "lat": 22.5, "lon": 114.1, "rel_alt": 100.1, "abs_alt": 135.0, "width": 4000.0, "height": 3000.0, "focal": 4.5, "focal35": 24.0}
    assert images.metadata_of(b"") == {} and images.metadata_of(b"\xff\xd8\xff\xe1\x00") == {}


@pytest.fixture
def folder(tmp_path):
    for i, name in enumerate(["b.jpg", "a.JPG", "c.Jpg", "d.tif", "e.txt"]):
        (tmp_path / name).write_bytes(jpeg(VALUES | {"GpsLatitude": f"{22.5 + i / 1000}"}))
    for k in VALUES:
        (tmp_path / f"no_{k}.jpg").write_bytes(jpeg({n: v for n, v in VALUES.items() if n != k}))
    (tmp_path / "no_exif.jpg").write_bytes(jpeg(with_exif=False))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.jpg").write_bytes(jpeg())
    return tmp_path


def test_folder_scan(spark, folder):
    meta = images.read_metadata(spark, str(folder))
    assert meta.count() == 2 + len(VALUES) + 1
    table = images.image_table(meta).orderBy("image_id").collect()
    assert [(r.image_id, r.path.rpartition("/")[2]) for r in table] == [(0, "a.JPG"), (1, "b.jpg")]
    missing = {r.path.rpartition("/")[2]: r.missing for r in images.rejected(meta).collect()}
    assert missing["no_exif.jpg"] == ["width", "height"] and missing["no_GpsLatitude.jpg"] == ["lat"] and len(missing) == len(VALUES) + 1


ALTITUDE, WIDTH, HEIGHT = 20.0, 200, 150


def photo(spark, ground, name, east, north, yaw):
    """A JPEG of the ground (ten pixels a metre, from -60 m) as the camera model sees it, with its metadata."""
    a = np.radians(yaw)
    fx, fy = WIDTH * 24 / 36, HEIGHT * 24 / 24
    v, u = np.mgrid[0:HEIGHT, 0:WIDTH]
    dx, dy = (u - WIDTH / 2) / fx * ALTITUDE, (v - HEIGHT / 2) / fy * ALTITUDE
    # world_to_camera of a camera that looks down turns by yaw about the vertical
    x, y = east + np.cos(a) * dx - np.sin(a) * dy, north + np.sin(a) * dx + np.cos(a) * dy
    img = ground[np.clip(((y + 60) * 10).astype(int), 0, len(ground) - 1), np.clip(((x + 60) * 10).astype(int), 0, len(ground) - 1)]
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(WIDTH, HEIGHT, 1)
    packed = (img.astype(int) * 0x010101).ravel().tolist()
    array = spark._sc._gateway.new_array(jvm.int, len(packed))
    for i, p in enumerate(packed):
        array[i] = p
    picture.setRGB(0, 0, WIDTH, HEIGHT, array, 0, WIDTH)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(name)))
    data = name.read_bytes()
    values = VALUES | {"GimbalYawDegree": f"{yaw}", "GpsLatitude": f"{22.5 + north / 110744.5:.9f}", "GpsLongitude": f"{114.1 + east / 102911.2:.9f}", "RelativeAltitude": f"+{ALTITUDE}"}
    head = jpeg(values)[2:-2].replace(exif(), exif(WIDTH, HEIGHT))
    name.write_bytes(data[:2] + head + data[2:])


@pytest.fixture(scope="module")
def photos(spark, tmp_path_factory):
    """A small survey over random ground, and files that don't belong to it."""
    folder, rng = tmp_path_factory.mktemp("photos"), np.random.default_rng(5)
    ground = rng.integers(0, 256, (240, 240)).repeat(5, 0).repeat(5, 1).astype(float)
    for axis in (0, 1):  # soft edges
        ground = sum(np.roll(ground, k, axis) for k in range(-1, 2)) / 3
    spots = [(0.0, 0.0, 0), (6.0, 0.0, 0), (0.0, 5.0, 3), (6.0, 5.0, 0), (12.0, 2.0, -2)]
    for k, (east, north, yaw) in enumerate(spots):
        photo(spark, ground, folder / f"p{k}.jpg", east, north, yaw)
    (folder / "broken.jpg").write_bytes(jpeg())
    (folder / "nothing.jpg").write_bytes(b"nothing")
    (folder / "notes.txt").write_bytes(b"notes")
    return folder


def test_survey_command(spark, photos, tmp_path_factory):
    """From photos to points on the ground: one command writes every table."""
    out = str(tmp_path_factory.mktemp("out"))
    assert survey.main([str(photos), out, "--side", "200", "--least-matches", "30", "--match-score", "0.9", "--steps", "8", "--pictures"]) == 0
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    images = {r.image_id: r for r in table("images").collect()}
    assert sorted(r.path.rpartition("/")[2] for r in images.values()) == ["broken.jpg", *(f"p{k}.jpg" for k in range(5))]
    assert [r.path.rpartition("/")[2] for r in table("rejected").collect()] == ["nothing.jpg"]
    features = table("features")
    assert features.select("image_id").distinct().count() == 5 and features.count() > 500
    assert features.where("x < 1 OR y < 1 OR x > 198 OR y > 148").count() == 0  # none under the mask's border
    assert table("matches").groupBy("img_lhs", "img_rhs").count().agg({"count": "min"}).first()[0] >= 30
    stats = table("tracks").groupBy("track_id").agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("node") / survey.SPAN)).alias("images"))
    assert stats.where("n <> images").count() == 0
    z = np.array([r.Z for r in table("points").where("n_views > 2").collect()])
    # The ground is level; what the plain scorer matches wrongly lies anywhere.
    assert len(z) > 50 and abs(np.median(z)) < 1 and np.mean(np.abs(z - np.median(z)) < 1) > 0.5
    assert table("cameras").count() == 6 and table("lines").count() == table("matches").count()
    assert len([p for p in Path(out, "rectified").iterdir() if p.suffix == ".png"]) == 10
    assert survey.main([str(photos / "nowhere"), out]) == 1


def test_stream_of_new_files(spark, folder, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(n)) for n in ("stream", "state"))
    for expected in (len(VALUES) + 3, len(VALUES) + 4):
        ingest.start(spark, str(folder), out, state).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        (folder / "new.png").write_bytes(b"x")


def test_pixels_of_a_bitmap(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (6, 8, 3)).astype(np.uint8)
    (tmp_path / "a.bmp").write_bytes(fixtures.bitmap(img))
    (tmp_path / "bad.bmp").write_bytes(b"BM nothing")
    (r,) = images.read_pixels(spark, str(tmp_path)).collect()
    assert (r.height, r.width, r.nChannels) == (6, 8, 3)
    assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(6, 8, 3), img)


def test_stored_features(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, 1.0, 2.0, 0.5, [1.0, 2.0]) for i in range(9)], "image_id long, feat_idx int, x double, y double, score double, desc array<double>")
    store.write_features(df, str(tmp_path / "f"), 2)
    back = store.read_features(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.select("image_id", "feat_idx").collect())) == sorted(map(tuple, df.select("image_id", "feat_idx").collect()))


def test_descriptor_files(spark, tmp_path):
    """Also where the first float begins with bytes that are digits."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 12, 100):
        rows = rng.normal(size=(n, 130)).astype("<f4")
        if n:
            rows[0, 0] = np.frombuffer(b"1234", "<f4")[0]
        assert np.array_equal(store.features_of(str(n).encode() + rows.tobytes(), 128), rows)
    with pytest.raises(ValueError):
        store.features_of(b"3" + bytes(130 * 4), 128)
    rows = [(f"p{i % 3}", i // 3, float(i), 0.5 * i, [float(i)] * 128) for i in range(30)]
    df = spark.createDataFrame(rows, "stem string, feat_idx long, x double, y double, descriptor array<double>")
    store.write_descriptors(df, f"file://{tmp_path}/d")
    assert sorted(map(tuple, store.read_descriptors(spark, str(tmp_path / "d"), 128).collect())) == sorted(rows)


def test_match_pictures(spark, tmp_path):
    left, right = np.zeros((4, 6, 3), np.uint8), np.full((5, 3, 3), 9, np.uint8)
    out = store.line_picture(left, right, [(0, 0, 2, 0), (5, 3, 0, 3)])
    assert out.shape == (5, 9, 3) and (out[0] == out[0, 0]).all() and out[0, 0].min() >= 55
    assert (out[4, :6] == 0).all() and (out[4, 6:] == 9).all() and (out[3, 5] == out[3, 6]).all()
    images = spark.createDataFrame([(i, *img.shape, bytearray(img.tobytes())) for i, img in enumerate((left, right))], "image_id long, height int, width int, nChannels int, data binary")
    lines = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0, 0.0), (0, 1, 5.0, 3.0, 0.0, 3.0)], "img_lhs long, img_rhs long, x0 double, y0 double, x1 double, y1 double")
    store.write_match_pictures(lines, images, str(tmp_path / "m"))
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["0_1_matches.png"]


def test_learned_detector_and_matcher(spark, tmp_path):
    """Model files through the adapters, in tasks: bright pixels as features, like descriptors as matches."""
    (tmp_path / "d.onnx").write_bytes(onnx_file.bright_pixels(0.5))
    (tmp_path / "m.onnx").write_bytes(onnx_file.like_pairs(1.0))
    img = np.zeros((20, 30, 3), np.uint8)
    spots = {(5, 4): 255, (20, 10): 204, (25, 15): 153, (0, 0): 255}  # the last one under the mask's border
    for (x, y), v in spots.items():
        img[y, x] = v
    for uri in (str(tmp_path / "d.onnx"), f"file://{tmp_path}/d.onnx"):
        table = spark.createDataFrame([(i, 20, 30, 3, bytearray(img.tobytes())) for i in (0, 1)], "image_id long, height int, width int, nChannels int, data binary")
        found = features.extract(table, models.detector(uri))
        got = {(r.x, r.y): (r.score, r.descriptor) for r in found.where("image_id = 0").collect()}
        assert set(got) == {(5.0, 4.0), (20.0, 10.0), (25.0, 15.0)}
        assert all(np.allclose([s, *d], [v / 255, v / 255, (v / 255) ** 2], atol=1e-4) for (xy, (s, d)), v in zip(sorted(got.items()), (255, 204, 153), strict=True))
    pairs = spark.createDataFrame([(0, 1)], "img_lhs long, img_rhs long")
    raw = matching.score_with(pairs, features.strongest(found), models.matcher(str(tmp_path / "m.onnx"))).collect()
    value = {r.feat_idx: r.score for r in found.where("image_id = 0").collect()}
    product = {(a, b): value[a] * value[b] + value[a] ** 2 * value[b] ** 2 for a in value for b in value}
    assert {(r.lhs, r.rhs) for r in raw} == {k for k, v in product.items() if v > 1}
    assert all(abs(r.score - product[r.lhs, r.rhs]) < 1e-3 for r in raw)
    assert models.detector(None) is None and models.matcher(None) is None


def test_models_need_their_file():
    with pytest.raises(FileNotFoundError):
        models.OnnxDetector("/nowhere.onnx")(np.zeros((8, 8, 3), np.uint8))
    with pytest.raises(FileNotFoundError):
        models.OnnxPairMatcher("/nowhere.onnx")([], [], [], [])


def test_plan_from_features_to_points(spark):
    """Points seen by three cameras come back through matching, tracks, triangulation and adjustment."""
    rng = np.random.default_rng(3)
    scene = np.column_stack([rng.uniform(0, 20, (150, 2)), rng.uniform(0, 2, 150)])
    desc = rng.normal(size=(150, 16))
    cams = {0: (5.0, 5.0, 100.0), 1: (15.0, 12.0, 100.0), 2: (8.0, 18.0, 95.0)}
    rows = []
    for i, c in cams.items():
        for k, (p, d) in enumerate(zip(scene, desc, strict=True)):
            u, v = 3000 * (p[0] - c[0]) / (c[2] - p[2]), -3000 * (p[1] - c[1]) / (c[2] - p[2])
            rows.append((i, k, float(u), float(v), 0.5, d.tolist()))
    f = spark.createDataFrame(rows, "image_id long, feat_idx long, x double, y double, score double, descriptor array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "img_lhs long, img_rhs long")
    cameras = spark.createDataFrame([(i, 0.0, 1.0, 0.0, 0.0, *c, 3000.0, 3000.0, 0.0, 0.0) for i, c in cams.items()], adjust.CAMERA_SCHEMA)
    found = survey.reconstruct(pairs, f, cameras)
    points = found["points"].collect()
    assert len(points) == 150 and all(r.n_views == 3 for r in points)
    got = np.array(sorted((r.X, r.Y, r.Z) for r in points))
    assert np.allclose(got, sorted(map(tuple, scene)), atol=1e-6)
    assert features.strongest(f, top=10).count() == 30
    assert raster.SMALLEST == 5
