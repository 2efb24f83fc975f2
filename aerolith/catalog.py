"""All registered queries of the photogrammetry operators, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.config import DEFAULT
from aerolith.functions import geo, mat, polygon, raster
from aerolith.operators import adjust, matching, mosaic, neighbours, ranges, tracks, triangulate, weakest
from aerolith.operators import features as feats
from aerolith.runtime import ordered_ids, upper_medians, written
from aerolith.sources import fixtures, images
from aerolith.sources.fixtures import observations, observations_sql, view, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STRICT_MATCHES = 118
FRAME = (1024.0, 768.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL equivalent if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(x: Column | str, places: int = 6) -> Column:
    return geo.rounded(F.col(x) if isinstance(x, str) else x, places)


def rs(x: str, places: int = 6) -> str:
    return f"round_even(({x}) * 1e{places}, 0) / 1e{places} + 0.0"


def named(values: list[mat.Entry], names: list[str], places: int = 6) -> list[Column]:
    return [r(v, places).alias(n) for v, n in zip(values, names, strict=True)]


# ---------------------------------------------------------------- images, poses, cameras

VALID = "regexp_extract(path, '(\\.[^./]+)$', 1) IN (" + ", ".join(f"'{x}', '{x.upper()}'" for x in images.EXTENSIONS) + ")"
WGS = "(2 * (1 / CAST(298.257223563 AS DOUBLE)) - (1 / CAST(298.257223563 AS DOUBLE)) * (1 / CAST(298.257223563 AS DOUBLE)))"
LOCATED = f"""i AS ({view_sql("images")}),
ref AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY lat DESC) AS lat0, percentile_disc(0.5) WITHIN GROUP (ORDER BY lon DESC) AS lon0 FROM i),
w AS (SELECT *, 1 - {WGS} * pow(sin(radians(lat0)), 2) AS w FROM i, ref),
loc AS (SELECT *, CAST(6378137 AS DOUBLE) / sqrt(w) * (radians(lon) - radians(lon0)) * cos(radians(lat0)) AS x,
  CAST(6378137 AS DOUBLE) * (1 - {WGS}) / pow(w, 1.5) * (radians(lat) - radians(lat0)) AS y FROM w)"""
#: Closed forms of the columns c0, c1, c2 of the levelling rotation; world to camera has rows -c2, c1, c0.
TURNED = f"""{LOCATED},
t AS (SELECT *, cos(radians(-yaw)) AS ca, sin(radians(-yaw)) AS sa, cos(radians(-pitch)) AS cb, sin(radians(-pitch)) AS sb, cos(radians(-roll)) AS cc, sin(radians(-roll)) AS sc FROM loc),
rot AS (SELECT *, -(sa * sc - ca * sb * cc) AS r00, -(ca * sc + sa * sb * cc) AS r01, -(cb * cc) AS r02,
  sa * cc + ca * sb * sc AS r10, ca * cc - sa * sb * sc AS r11, -cb * sc AS r12, ca * cb AS r20, -sa * cb AS r21, sb AS r22 FROM t)"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_reference(view(spark, sf_dir, "images"))


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_rotation(_located(spark, sf_dir))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS scan_id, path, regexp_extract(path, '(\\.[^./]+)$', 1) AS ext
FROM ({view_sql("images")}) i WHERE {VALID} AND abs_alt IS NOT NULL""")
def image_scan_validate(spark, sf_dir):
    meta = view(spark, sf_dir, "images").where(images.valid_extension(F.col("path")))
    valid = images.with_required(meta).select("path", geo.path_extension(F.col("path")).alias("ext"))
    return ordered_ids(valid, "path", "scan_id").select("scan_id", "path", "ext")


PHOTO = ["yaw", "pitch", "roll", "lat", "lon", "rel_alt", "abs_alt", "width", "height", "focal", "focal35"]


@query(f"""SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS image_id, regexp_extract(path, '([^/]*)$', 1) AS name, {", ".join(PHOTO)}
FROM ({view_sql("images")}) i WHERE {VALID} AND abs_alt IS NOT NULL""")
def photo_metadata(spark, sf_dir):
    """A folder of files, written first, is listed, read and numbered: the image table from the files' own metadata."""
    table = images.image_table(images.read_metadata(spark, fixtures.photos(spark, sf_dir)))
    return table.select("image_id", geo.path_name(F.col("path")).alias("name"), *PHOTO)


@query(f"""SELECT concat(CAST(image_id AS STRING), '.bmp') AS name, CAST(6 AS INTEGER) AS height, CAST(9 AS INTEGER) AS width, {", ".join(f"CAST(sum((image_id * 7 + x * 3 + y * 5 + {c * 11}) % 256) AS BIGINT) AS total_{n}" for c, n in enumerate(("blue", "green", "red")))}
FROM ({view_sql("images")}) i, (SELECT range AS x FROM range(9)) a, (SELECT range AS y FROM range(6)) b WHERE image_id % 9 <> 4 GROUP BY image_id""")
def photo_pixels(spark, sf_dir):
    """Bitmaps, written first, are decoded; files that don't decode are left out."""
    pixels = images.read_pixels(spark, fixtures.bitmaps(spark, sf_dir))
    bytes_of = lambda c: F.aggregate(F.sequence(F.lit(c), F.length("data") - 1, F.lit(3)), F.lit(0).cast("long"), lambda acc, i: acc + F.conv(F.hex(F.expr("data").substr(i + 1, F.lit(1))), 16, 10).cast("long"))
    return pixels.select(geo.path_name(F.col("origin")).alias("name"), "height", "width", *(bytes_of(c).alias(f"total_{n}") for c, n in enumerate(("blue", "green", "red"))))


@query(f"""SELECT path, 'abs_alt' AS missing FROM ({view_sql("images")}) i WHERE abs_alt IS NULL""")
def metadata_rejects(spark, sf_dir):
    return images.rejected(view(spark, sf_dir, "images")).select("path", F.array_join("missing", ",").alias("missing"))


@query(f"""SELECT image_id, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^./]+$', '') AS stem,
regexp_extract(path, '(\\.[^./]+)$', 1) AS ext FROM ({view_sql("images")}) i""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return view(spark, sf_dir, "images").select("image_id", geo.path_name(p).alias("name"), geo.path_stem(p).alias("stem"), geo.path_extension(p).alias("ext"))


@query(f"WITH {LOCATED} SELECT {rs('lat0', 9)} AS lat0, {rs('lon0', 9)} AS lon0 FROM ref")
def reference_coord(spark, sf_dir):
    lat0, lon0 = upper_medians(view(spark, sf_dir, "images"), ["lat", "lon"])
    return spark.createDataFrame([(lat0, lon0)], "lat0 double, lon0 double").select(r("lat0", 9).alias("lat0"), r("lon0", 9).alias("lon0"))


@query(f"WITH {LOCATED} SELECT image_id, {rs('x', 4)} AS x, {rs('y', 4)} AS y, {rs('-rel_alt', 4)} AS z FROM loc")
def local_coords(spark, sf_dir):
    return _located(spark, sf_dir).select("image_id", r("x", 4).alias("x"), r("y", 4).alias("y"), r(-F.col("rel_alt"), 4).alias("z"))


NINE = [f"r{i}{j}" for i in range(3) for j in range(3)]


@query(f"WITH {TURNED} SELECT image_id, {', '.join(f'{rs(c)} AS {c}' for c in NINE)} FROM rot")
def pose_rotation(spark, sf_dir):
    return _posed(spark, sf_dir).select("image_id", *named([x for row in geo.rotation_columns() for x in row], NINE))


QUATERNION = f"""{TURNED},
m AS (SELECT *, greatest(r00 + r11 + r22 + 1, 0) AS w2, greatest(1 + r00 - r11 - r22, 0) AS x2, greatest(1 - r00 + r11 - r22, 0) AS y2, greatest(1 - r00 - r11 + r22, 0) AS z2 FROM rot),
u AS (SELECT image_id, sqrt(w2) / 2 AS w, CASE WHEN r21 < r12 THEN -sqrt(x2) / 2 ELSE sqrt(x2) / 2 END AS x,
  CASE WHEN r02 < r20 THEN -sqrt(y2) / 2 ELSE sqrt(y2) / 2 END AS y, CASE WHEN r10 < r01 THEN -sqrt(z2) / 2 ELSE sqrt(z2) / 2 END AS z FROM m)"""


QWXYZ = ["qw", "qx", "qy", "qz"]


def _quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _posed(spark, sf_dir).select("image_id", F.array(*mat.quaternion(geo.rotation_columns())).alias("q"))
    return raw.select("image_id", *(c.alias(n) for c, n in zip(mat.canonical([F.col("q")[i] for i in range(4)]), QWXYZ, strict=True)))


@query(f"WITH {QUATERNION} SELECT image_id, {', '.join(f'{rs(c, 5)} AS q{c}' for c in 'wxyz')} FROM u")
def pose_quaternion(spark, sf_dir):
    return _quaternions(spark, sf_dir).select("image_id", *(r(c, 5).alias(c) for c in QWXYZ))


@query(f"WITH {TURNED} SELECT image_id, {', '.join(f'{rs(c, 5)} AS {c}' for c in NINE)} FROM rot")
def quaternion_to_matrix(spark, sf_dir):
    back = mat.rotation([F.col(c) for c in QWXYZ])
    return _quaternions(spark, sf_dir).select("image_id", *named([x for row in back for x in row], NINE, 5))


@query(f"""SELECT image_id, {rs("width * focal35 / 36")} AS fx, {rs("height * focal35 / 24")} AS fy, {rs("width / 2")} AS cx, {rs("height / 2")} AS cy,
{rs("width * 28 / 36")} AS fx_default, {rs("height * 28 / 24")} AS fy_default FROM ({view_sql("images")}) i""")
def intrinsics(spark, sf_dir):
    size = F.col("width"), F.col("height"), F.col("focal")
    return view(spark, sf_dir, "images").select("image_id", *named([*geo.intrinsics(*size, F.col("focal35")), *geo.intrinsics(*size)[:2]], ["fx", "fy", "cx", "cy", "fx_default", "fy_default"]))


TWELVE = [f"p{i}{j}" for i in range(3) for j in range(4)]
PROJECTED = f"""{TURNED},
k AS (SELECT *, width * focal35 / 36 AS fx, height * focal35 / 24 AS fy, width / 2 AS cx, height / 2 AS cy,
  r00 * x + r01 * y - r02 * rel_alt AS r03, r10 * x + r11 * y - r12 * rel_alt AS r13, r20 * x + r21 * y - r22 * rel_alt AS r23 FROM rot)"""


@query(f"WITH {PROJECTED} SELECT image_id, " + ", ".join([f"{rs(f'fx * r0{j} + cx * r2{j}', 3)} AS p0{j}" for j in range(4)] + [f"{rs(f'fy * r1{j} + cy * r2{j}', 3)} AS p1{j}" for j in range(4)] + [f"{rs(f'r2{j}', 3)} AS p2{j}" for j in range(4)]) + " FROM k")
def projection_matrix(spark, sf_dir):
    k = geo.camera_matrix(*geo.intrinsics(F.col("width"), F.col("height"), F.col("focal"), F.col("focal35")))
    p = geo.projection(k, geo.rotation_columns(), [F.col("x"), F.col("y"), -F.col("rel_alt")])
    return _posed(spark, sf_dir).select("image_id", *named([x for row in p for x in row], TWELVE, 3))


CORNERS = f"""{TURNED},
c AS (SELECT *, 0 AS corner, CAST(0 AS DOUBLE) - width / 2 AS dx, CAST(0 AS DOUBLE) - height / 2 AS dy FROM rot
  UNION ALL SELECT *, 1, width - 1 - width / 2, -height / 2 FROM rot
  UNION ALL SELECT *, 2, width - 1 - width / 2, height - 1 - height / 2 FROM rot
  UNION ALL SELECT *, 3, -width / 2, height - 1 - height / 2 FROM rot),
n AS (SELECT *, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM c),
f AS (SELECT image_id, corner, (r00 * ux + r10 * uy + r20) / (r02 * ux + r12 * uy + r22) AS fx, (r01 * ux + r11 * uy + r21) / (r02 * ux + r12 * uy + r22) AS fy FROM n)"""


def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_footprint(_posed(spark, sf_dir)).select("image_id", "corners")


@query(f"WITH {CORNERS} SELECT image_id, CAST(corner AS BIGINT) AS corner, {rs('fx', 4)} AS x, {rs('fy', 4)} AS y FROM f")
def footprint_corners(spark, sf_dir):
    return _footprints(spark, sf_dir).select("image_id", F.posexplode("corners").alias("corner", "p")).select("image_id", F.col("corner").cast("long"), r("p.x", 4).alias("x"), r("p.y", 4).alias("y"))


@query(f"""WITH {CORNERS}, b AS (SELECT image_id, max(fx) - min(fx) AS w, max(fy) - min(fy) AS h FROM f GROUP BY image_id)
SELECT image_id, CAST(ceil(round(w * (CAST(4096 AS DOUBLE) / greatest(w, h)), 6)) AS BIGINT) AS width, CAST(ceil(round(h * (CAST(4096 AS DOUBLE) / greatest(w, h)), 6)) AS BIGINT) AS height FROM b""")
def rectified_canvas(spark, sf_dir):
    c = geo.canvas(F.col("corners"))
    return _footprints(spark, sf_dir).withColumn("c", c).select("image_id", F.col("c.width").cast("long").alias("width"), F.col("c.height").cast("long").alias("height"))


@query(f"""SELECT image_id, CAST(round(width * least(CAST(1024 AS DOUBLE) / width, CAST(1024 AS DOUBLE) / height, 1)) AS INTEGER) AS dw,
CAST(round(height * least(CAST(1024 AS DOUBLE) / width, CAST(1024 AS DOUBLE) / height, 1)) AS INTEGER) AS dh FROM ({view_sql("images")}) i""")
def decimated_size(spark, sf_dir):
    w, h = geo.decimated(F.col("width"), F.col("height"))
    return view(spark, sf_dir, "images").select("image_id", w.alias("dw"), h.alias("dh"))


# ---------------------------------------------------------------- neighbours

NEAREST = f"""{LOCATED},
d AS (SELECT p.image_id AS id, q.image_id AS neighbour_id, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 6) AS distance FROM loc p JOIN loc q ON p.image_id <> q.image_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS rank FROM d) z WHERE rank <= 8),
pr AS (SELECT DISTINCT least(id, neighbour_id) AS img_lhs, greatest(id, neighbour_id) AS img_rhs FROM nn)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_located(spark, sf_dir).select(F.col("image_id").alias("id"), "x", "y"))


@query(f"WITH {NEAREST} SELECT id, neighbour_id, CAST(rank AS INTEGER) AS rank, distance FROM nn")
def knn_neighbors(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(f"WITH {NEAREST} SELECT img_lhs, img_rhs FROM pr")
def neighbor_pairs(spark, sf_dir):
    return neighbours.proposed_pairs(_nearest(spark, sf_dir))


@query(f"WITH {NEAREST} SELECT image_id, count(*) AS degree FROM (SELECT img_lhs AS image_id FROM pr UNION ALL SELECT img_rhs FROM pr) e GROUP BY image_id")
def pair_degree(spark, sf_dir):
    return neighbours.pair_degree(neighbours.proposed_pairs(_nearest(spark, sf_dir)))


@query(f"WITH {NEAREST} SELECT img_lhs, count(*) AS n_pairs, min(img_rhs) AS first_rhs, max(img_rhs) AS last_rhs FROM pr GROUP BY img_lhs")
def pair_batches(spark, sf_dir):
    return neighbours.pair_batches(neighbours.proposed_pairs(_nearest(spark, sf_dir)))


# ---------------------------------------------------------------- features

STRONG = f"""fe AS ({view_sql("features")}),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, feat_idx) AS rank FROM fe WHERE score >= CAST(0.05 AS DOUBLE) AND x BETWEEN 2 AND 1021 AND y BETWEEN 2 AND 765) z WHERE rank <= {DEFAULT.features_per_image})"""


def _strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feats.strongest(feats.inside_mask(view(spark, sf_dir, "features"), int(FRAME[0]), int(FRAME[1])))


@query(f"WITH {STRONG} SELECT image_id, feat_idx, CAST(rank AS INTEGER) AS rank, {rs('score')} AS score FROM st")
def feature_threshold_topk(spark, sf_dir):
    return _strong(spark, sf_dir).select("image_id", "feat_idx", "rank", r("score").alias("score"))


@query(f"SELECT image_id, feat_idx, {rs('(x - 512) / 512')} AS nx, {rs('(y - 384) / 512')} AS ny FROM ({view_sql('features')}) f")
def feature_normalise(spark, sf_dir):
    return feats.normalised(view(spark, sf_dir, "features"), *FRAME).select("image_id", "feat_idx", r("nx").alias("nx"), r("ny").alias("ny"))


@query(f"SELECT image_id, feat_idx, {rs('x')} AS x, {rs('y')} AS y FROM ({view_sql('features')}) f")
def feature_denormalise(spark, sf_dir):
    return feats.denormalised(feats.normalised(view(spark, sf_dir, "features"), *FRAME), *FRAME).select("image_id", "feat_idx", r("x").alias("x"), r("y").alias("y"))


#: Pairs of neighbours among the images that have features.
FEATURED = NEAREST.replace("FROM loc p JOIN loc q", "FROM lf p JOIN lf q").replace("d AS (SELECT p.image_id", f"{STRONG}, lf AS (SELECT * FROM loc WHERE image_id IN (SELECT image_id FROM st)),\nd AS (SELECT p.image_id")


@query(f"""WITH {FEATURED}
SELECT a.image_id AS img_lhs, b.image_id AS img_rhs, a.feat_idx AS lhs, b.feat_idx AS rhs, {rs("list_cosine_similarity(a.descriptor, b.descriptor)", 4)} AS score
FROM pr JOIN st a ON a.image_id = img_lhs JOIN st b ON b.image_id = img_rhs WHERE list_cosine_similarity(a.descriptor, b.descriptor) >= CAST(0.2 AS DOUBLE)""")
def descriptor_similarity(spark, sf_dir):
    strong = _strong(spark, sf_dir)
    images = _located(spark, sf_dir).join(strong.select("image_id"), "image_id", "left_semi")
    pairs = neighbours.proposed_pairs(neighbours.nearest(images.select(F.col("image_id").alias("id"), "x", "y")))
    return matching.score_pairs(pairs, strong).select("img_lhs", "img_rhs", "lhs", "rhs", r("score", 4).alias("score"))


@query(f"""SELECT i.image_id, CAST(width * height * 3 AS BIGINT) AS image_bytes, CAST(coalesce(b, 0) AS BIGINT) AS feature_bytes FROM ({view_sql("images")}) i
LEFT JOIN (SELECT image_id, sum((len(descriptor) + 2) * 4) AS b FROM ({view_sql("features")}) f GROUP BY image_id) g ON g.image_id = i.image_id""")
def memory_accounting(spark, sf_dir):
    return feats.memory(view(spark, sf_dir, "features"), view(spark, sf_dir, "images"))


# ---------------------------------------------------------------- matches

GREEDY = f"""rm AS ({view_sql("raw_matches")}),
ok AS (SELECT * FROM rm WHERE score >= CAST(0.2 AS DOUBLE)),
bl AS (SELECT img_lhs, img_rhs, lhs, rhs, score FROM (SELECT *, row_number() OVER (PARTITION BY img_lhs, img_rhs, lhs ORDER BY score DESC, rhs) AS k FROM ok) z WHERE k = 1),
oo AS (SELECT img_lhs, img_rhs, lhs, rhs, score FROM (SELECT *, row_number() OVER (PARTITION BY img_lhs, img_rhs, rhs ORDER BY score DESC, lhs) AS k FROM bl) z WHERE k = 1),
pc AS (SELECT img_lhs, img_rhs, count(*) AS n_matches FROM oo GROUP BY img_lhs, img_rhs)"""


def _one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.one_to_one(matching.above(view(spark, sf_dir, "raw_matches")))


@query(f"WITH {GREEDY} SELECT img_lhs, img_rhs, lhs, rhs, score FROM ok")
def match_threshold(spark, sf_dir):
    return matching.above(view(spark, sf_dir, "raw_matches"))


@query(f"WITH {GREEDY} SELECT * FROM bl")
def match_best_lhs(spark, sf_dir):
    return matching.best_per_lhs(matching.above(view(spark, sf_dir, "raw_matches")))


@query(f"WITH {GREEDY} SELECT * FROM oo")
def match_greedy_one_to_one(spark, sf_dir):
    return _one_to_one(spark, sf_dir)


@query(f"WITH {GREEDY} SELECT * FROM pc WHERE n_matches >= 100")
def valid_pairs(spark, sf_dir):
    return matching.valid_pairs(_one_to_one(spark, sf_dir))


@query(f"WITH {GREEDY} SELECT * FROM pc WHERE n_matches >= {STRICT_MATCHES}")
def valid_pairs_strict(spark, sf_dir):
    return matching.valid_pairs(_one_to_one(spark, sf_dir), STRICT_MATCHES)


@query(f"WITH {GREEDY} SELECT DISTINCT img_lhs, img_rhs FROM rm WHERE (img_lhs, img_rhs) NOT IN (SELECT (img_lhs, img_rhs) FROM pc WHERE n_matches >= {STRICT_MATCHES})")
def rejected_pairs(spark, sf_dir):
    every = view(spark, sf_dir, "raw_matches").select("img_lhs", "img_rhs").distinct()
    return matching.rejected_pairs(every, matching.valid_pairs(_one_to_one(spark, sf_dir), STRICT_MATCHES))


LINES = f"""{GREEDY},
ml AS (SELECT img_lhs, img_rhs, lhs, rhs, CAST(lhs % 37 AS DOUBLE) AS x0, CAST(lhs % 11 AS DOUBLE) AS y0, CAST(rhs % 37 AS DOUBLE) AS x1, CAST(rhs % 11 AS DOUBLE) AS y1, score FROM oo),
en AS (SELECT img_lhs AS image_id, x0 AS px, y0 AS py, img_lhs, img_rhs, lhs, lhs AS feat_idx FROM ml UNION ALL SELECT img_rhs, x1, y1, img_lhs, img_rhs, lhs, rhs FROM ml),
fs AS (SELECT image_id, px, py, min(struct_pack(a := img_lhs, b := img_rhs, c := lhs, d := feat_idx)) AS first FROM en GROUP BY image_id, px, py),
kd AS (SELECT image_id, px, py, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first, px, py) - 1 AS BIGINT) AS pnt_idx FROM fs)"""


def _points(matches: DataFrame) -> DataFrame:
    """Coordinates for every feature that matches name."""
    ends = matches.select(F.explode(F.array(F.struct(F.col("img_lhs").alias("image_id"), F.col("lhs").alias("feat_idx")), F.struct(F.col("img_rhs").alias("image_id"), F.col("rhs").alias("feat_idx")))).alias("e"))
    return ends.select("e.*").distinct().withColumn("x", (F.col("feat_idx") % 37).cast("double")).withColumn("y", (F.col("feat_idx") % 11).cast("double"))


@query(f"WITH {LINES} SELECT * FROM kd")
def keypoint_dictionary(spark, sf_dir):
    found = _one_to_one(spark, sf_dir)
    return matching.keypoint_dictionary(found, _points(found))


@query(f"WITH {LINES} SELECT img_lhs, img_rhs, lhs, rhs, x0, y0, x1, y1, score FROM ml")
def match_lines(spark, sf_dir):
    found = _one_to_one(spark, sf_dir)
    return matching.located(found, _points(found))


@query(f"""WITH {LINES} SELECT ml.img_lhs, ml.img_rhs, a.pnt_idx AS pnt_lhs, b.pnt_idx AS pnt_rhs, score FROM ml
JOIN kd a ON a.image_id = ml.img_lhs AND a.px = x0 AND a.py = y0 JOIN kd b ON b.image_id = ml.img_rhs AND b.px = x1 AND b.py = y1""")
def encoded_matches(spark, sf_dir):
    found = _one_to_one(spark, sf_dir)
    return matching.encoded(found, _points(found))


# ---------------------------------------------------------------- tracks

EDGES = f"""{GREEDY},
ew AS (SELECT img_lhs * 1000 + lhs AS a, img_rhs * 1000 + rhs AS b, max(score) AS score FROM oo GROUP BY 1, 2)"""
#: The smallest label around spreads until nothing changes; a row for each node is kept.
REACHED = f"""RECURSIVE {EDGES},
sy AS (SELECT a, b FROM ew UNION SELECT b, a FROM ew),
reach(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM sy
  UNION SELECT sy.b, min(reach.root) FROM reach JOIN sy ON sy.a = reach.node JOIN recurring.reach known ON known.node = sy.b WHERE reach.root < known.root GROUP BY sy.b),
tr AS (SELECT root AS track_id, node FROM reach)"""
IMAGE_OF = "CAST(floor(node / 1000) AS BIGINT)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _one_to_one(spark, sf_dir)
    return found.select((F.col("img_lhs") * 1000 + F.col("lhs")).alias("a"), (F.col("img_rhs") * 1000 + F.col("rhs")).alias("b"), "score")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.edge_weights(_links(spark, sf_dir))


@query(f"WITH rm AS ({view_sql('raw_matches')}) SELECT img_lhs * 1000 + lhs AS a, img_rhs * 1000 + rhs AS b, max(score) AS score FROM rm WHERE score >= CAST(0.2 AS DOUBLE) GROUP BY 1, 2")
def edge_weights(spark, sf_dir):
    raw = matching.above(view(spark, sf_dir, "raw_matches"))
    return tracks.edge_weights(raw.select((F.col("img_lhs") * 1000 + F.col("lhs")).alias("a"), (F.col("img_rhs") * 1000 + F.col("rhs")).alias("b"), "score"))


@query(f"WITH {EDGES} SELECT a, b, score FROM ew UNION ALL SELECT b, a, score FROM ew")
def edge_symmetric(spark, sf_dir):
    return tracks.symmetric(_edges(spark, sf_dir))


@query(f"WITH {REACHED} SELECT track_id, node FROM tr")
def tracks_raw(spark, sf_dir):
    return tracks.tracks(_edges(spark, sf_dir))


@query(f"WITH {REACHED} SELECT track_id, count(*) AS n_points, count(DISTINCT CAST(floor(node / 1000) AS BIGINT)) AS n_images FROM tr GROUP BY track_id")
def track_stats(spark, sf_dir):
    return tracks.tracks(_edges(spark, sf_dir)).groupBy("track_id").agg(F.count("*").alias("n_points"), F.countDistinct(F.expr(IMAGE_OF)).alias("n_images"))


@query(f"WITH {REACHED} SELECT track_id, CAST(floor(node / 1000) AS BIGINT) AS image_id, count(*) AS n_points FROM tr GROUP BY 1, 2 HAVING count(*) > 1")
def track_conflicts(spark, sf_dir):
    return tracks.conflicts(tracks.tracks(_edges(spark, sf_dir)), IMAGE_OF)


#: In every round each edge joins its clusters that comes first, among the edges between clusters without a common image,
#: at both of them. An edge whose clusters share an image never comes back, as clusters only grow.
JOINED = f"""RECURSIVE {EDGES},
pt AS (SELECT DISTINCT node, CAST(floor(node / 1000) AS BIGINT) AS image FROM (SELECT a AS node FROM ew UNION ALL SELECT b FROM ew) n),
cl(node, cluster, image) USING KEY (node) AS (SELECT node, node, image FROM pt UNION (
  WITH op AS (SELECT x.cluster AS p, y.cluster AS q, ew.a, ew.b, score FROM ew JOIN recurring.cl x ON x.node = ew.a JOIN recurring.cl y ON y.node = ew.b WHERE x.cluster <> y.cluster),
  sh AS (SELECT DISTINCT p, q FROM (SELECT DISTINCT p, q FROM op) d JOIN recurring.cl x ON x.cluster = p JOIN recurring.cl y ON y.cluster = q AND y.image = x.image),
  fr AS (SELECT op.* FROM op LEFT JOIN sh ON sh.p = op.p AND sh.q = op.q WHERE sh.p IS NULL),
  fi AS (SELECT c, min(e) AS e FROM (SELECT p AS c, struct_pack(s := -score, a := a, b := b) AS e FROM fr UNION ALL SELECT q, struct_pack(s := -score, a := a, b := b) FROM fr) z GROUP BY c),
  mv AS (SELECT greatest(p, q) AS old, least(p, q) AS new FROM fr JOIN fi u ON u.c = p AND u.e = struct_pack(s := -score, a := a, b := b) JOIN fi v ON v.c = q AND v.e = struct_pack(s := -score, a := a, b := b))
  SELECT k.node, mv.new, k.image FROM recurring.cl k JOIN mv ON mv.old = k.cluster))"""


@query(f"WITH {JOINED} SELECT min(node) OVER (PARTITION BY cluster) AS track_id, node FROM cl")
def tracks_conflict_free(spark, sf_dir):
    return tracks.conflict_free_tracks(_edges(spark, sf_dir), IMAGE_OF)


@query(f"WITH {JOINED} SELECT min(node) OVER (PARTITION BY cluster) AS track_id, node FROM cl")
def tracks_conflict_free_rounds(spark, sf_dir):
    """The distributed rounds, which components beyond a task's size take."""
    return tracks.conflict_free_tracks(_edges(spark, sf_dir), IMAGE_OF, task_edges=0)


#: Small graphs, one or more for each order; points of one image have equal remainders by three.
SMALL = f"""RECURSIVE ol AS ({view_sql("order_links")}),
se AS (SELECT a, b, max(score) AS score FROM ol GROUP BY a, b),
sy AS (SELECT a, b, a AS lo, b AS hi, score FROM se UNION ALL SELECT b, a, a, b, score FROM se),
pa(s, t, seen, low) AS (SELECT a, b, [a, b], struct_pack(v := score, a := lo, b := hi) FROM sy
  UNION ALL SELECT s, sy.b, list_append(seen, sy.b), least(low, struct_pack(v := score, a := lo, b := hi)) FROM pa JOIN sy ON sy.a = pa.t WHERE NOT list_contains(seen, sy.b))"""


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.edge_weights(view(spark, sf_dir, "order_links"))


@query(f"WITH {SMALL} SELECT s, t, low.a AS a, low.b AS b, low.v AS score FROM (SELECT s, t, min(low) AS low FROM pa WHERE s < t AND s % 3 = t % 3 GROUP BY s, t) m")
def track_weakest_edges(spark, sf_dir):
    """For each two points of one image in a graph the weakest edge on any simple path between them."""
    edges = written(_order_edges(spark, sf_dir), "orders")
    points = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.floor(F.col("node") / 8).alias("g"), (F.col("node") % 3).alias("image"))
    pairs = points.select(F.col("node").alias("s"), "g", "image").join(points.select(F.col("node").alias("t"), "g", "image"), ["g", "image"]).where("s < t")
    return weakest.weakest_between(edges, pairs)


@query()
def tracks_by_removal(spark, sf_dir):
    return weakest.tracks_by_removal(_order_edges(spark, sf_dir), "node % 3")


# ---------------------------------------------------------------- points

SEEN = f"ob AS ({observations_sql()})"


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumns({"vx": F.col("u") / F.col("fx"), "vy": F.col("v") / F.col("fy"), "vz": F.lit(-1.0)})


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene points moved off their place by up to 6 cm."""
    move = F.lit(0.01) * (F.col("track_id") % 7)
    return view(spark, sf_dir, "scene_points").select("track_id", (F.col("X") + move).alias("X"), "Y", (F.col("Z") - move).alias("Z"), F.lit(True).alias("usable"))


@query(f"WITH {SEEN} SELECT track_id, {rs('min(X)')} AS x, {rs('min(Y)')} AS y, {rs('min(Z)')} AS z, true AS usable, count(*) AS n_views FROM ob GROUP BY track_id HAVING count(*) > 1")
def triangulate_linear(spark, sf_dir):
    return triangulate.linear(_rays(spark, sf_dir)).select("track_id", *(r(c).alias(c.lower()) for c in "XYZ"), "usable", "n_views")


@query(f"""WITH {SEEN}, ry AS (SELECT *, u / fx AS vx, v / fy AS vy, CAST(-1 AS DOUBLE) AS vz FROM ob),
m AS (SELECT *, avg(vx) OVER p AS mx, avg(vy) OVER p AS my, avg(vz) OVER p AS mz, avg(cx) OVER p AS nx, avg(cy) OVER p AS ny, avg(cz) OVER p AS nz FROM ry WINDOW p AS (PARTITION BY track_id)),
s AS (SELECT track_id, count(*) AS n_views, min(mx) AS mx, min(my) AS my, min(mz) AS mz, min(nx) AS nx, min(ny) AS ny, min(nz) AS nz,
  -sum((vx - mx) * (cx - nx) + (vy - my) * (cy - ny) + (vz - mz) * (cz - nz)) / sum(pow(vx - mx, 2) + pow(vy - my, 2) + pow(vz - mz, 2)) AS d FROM m GROUP BY track_id HAVING count(*) > 1)
SELECT track_id, {rs("mx * d + nx", 4)} AS x, {rs("my * d + ny", 4)} AS y, {rs("mz * d + nz", 4)} AS z, n_views FROM s""")
def triangulate_shared_depth(spark, sf_dir):
    return triangulate.shared_depth(_rays(spark, sf_dir)).select("track_id", *(r(c, 4).alias(c.lower()) for c in "XYZ"), "n_views")


MOVED = f"""{SEEN}, mv AS (SELECT track_id, fx * (X + CAST(0.01 AS DOUBLE) * (track_id % 7) - cx) / (cz - (Z - CAST(0.01 AS DOUBLE) * (track_id % 7))) - u AS du,
fy * (Y - cy) / (cz - (Z - CAST(0.01 AS DOUBLE) * (track_id % 7))) - v AS dv FROM ob)"""


@query(f"WITH {MOVED} SELECT track_id, {rs('sqrt(avg(du * du + dv * dv))', 5)} AS rmse, count(*) AS n_views FROM mv GROUP BY track_id")
def reprojection_error(spark, sf_dir):
    res = triangulate.residuals(_shifted(spark, sf_dir), observations(spark, sf_dir))
    return triangulate.rmse(res).select("track_id", r("rmse", 5).alias("rmse"), "n_views")


@query(f"WITH {MOVED} SELECT track_id, {rs('sum(CASE WHEN du * du + dv * dv <= 1 THEN du * du + dv * dv ELSE 2 * sqrt(du * du + dv * dv) - 1 END) / 2', 5)} AS cost FROM mv GROUP BY track_id")
def huber_cost(spark, sf_dir):
    res = triangulate.residuals(_shifted(spark, sf_dir), observations(spark, sf_dir))
    return triangulate.cost(res).select("track_id", r("cost", 5).alias("cost"))


@query(f"WITH {SEEN} SELECT track_id, {rs('min(X)', 4)} AS x, {rs('min(Y)', 4)} AS y, {rs('min(Z)', 4)} AS z, true AS usable, count(*) AS n_views FROM ob GROUP BY track_id HAVING count(*) > 1")
def triangulate_robust(spark, sf_dir):
    """Started off its place, the refinement returns to the scene's points."""
    seen = observations(spark, sf_dir)
    several = seen.groupBy("track_id").agg(F.count("*").alias("n")).where("n > 1")
    start = _shifted(spark, sf_dir).join(several, "track_id", "left_semi")
    return triangulate.robust(start, seen).select("track_id", *(r(c, 4).alias(c.lower()) for c in "XYZ"), "usable", "n_views")


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations off their place by up to 1.5 pixels, and one in eleven by 40 pixels more."""
    seed = F.col("track_id") * 7 + F.col("image_id") * 13
    off = lambda k: (F.pmod(seed * k, F.lit(31)) - 15) * 0.1
    outlier = F.when(F.pmod(seed, F.lit(11)) == 0, 40.0).otherwise(0.0)
    return observations(spark, sf_dir).withColumns({"u": F.col("u") + off(3) + outlier, "v": F.col("v") + off(5)})


@query(f"WITH {SEEN} SELECT track_id, count(*) AS n_views, CAST(0 AS DOUBLE) AS slope_x, CAST(0 AS DOUBLE) AS slope_y, CAST(0 AS DOUBLE) AS slope_z, true AS lower, true AS moved FROM ob GROUP BY track_id HAVING count(*) > 1")
def triangulate_outliers(spark, sf_dir):
    """Refinement under noise and outliers ends at a minimum of Huber's loss: its slope there, by finite differences of
    the loss that ``triangulate.cost`` computes, is nothing to two places a step of a metre; the loss is below the
    start's, and the solver took a step."""
    seen = written(_noisy(spark, sf_dir), "noisy")
    several = seen.groupBy("track_id").agg(F.count("*").alias("n")).where("n > 1")
    start = written(_shifted(spark, sf_dir).join(several, "track_id", "left_semi"), "start")
    found = written(triangulate.robust(start, seen), "refined")
    step, shifts = 1e-4, [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]

    # All losses from one join: each is a sum over the residuals of the point moved to its place.
    places = start.select("track_id", *(F.col(c).alias(f"{c}0") for c in "XYZ"))
    both = seen.drop("X", "Y", "Z").join(found.where("usable").join(places, "track_id"), "track_id")
    loss = lambda at: F.sum(geo.huber(triangulate.squared_at(at))) / 2
    losses = {f"c{k}": loss([F.col(c) + step * d for c, d in zip("XYZ", shift, strict=True)]) for k, shift in enumerate(shifts)}
    out = both.groupBy("track_id").agg(F.first("n_views").alias("n_views"), F.first("iterations").alias("iterations"), F.first("cost").alias("own"), loss([F.col(f"{c}0") for c in "XYZ"]).alias("at_start"), *(v.alias(k) for k, v in losses.items()))
    slope = lambda k: r((F.col(f"c{k}") - F.col(f"c{k + 1}")) / (2 * step) / F.col("c0"), 2)
    lower = (F.abs(F.col("own") - F.col("c0")) < 1e-6 * F.col("c0")) & (F.col("c0") <= F.col("at_start"))
    return out.select("track_id", "n_views", slope(1).alias("slope_x"), slope(3).alias("slope_y"), slope(5).alias("slope_z"), lower.alias("lower"), (F.col("iterations") > 0).alias("moved"))


def _looking_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras off their places."""
    return view(spark, sf_dir, "cameras").select(
        "image_id", F.lit(0.0).alias("qw"), F.lit(1.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"),
        (F.col("cx") + (F.col("image_id") % 3 - 1) * 0.05).alias("cx"), "cy", "cz", "fx", "fy", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"),
    )


@query(f"WITH {SEEN} SELECT track_id, count(*) AS n_views, CAST(0 AS DOUBLE) AS rmse FROM ob GROUP BY track_id HAVING count(*) > 1")
def bundle_adjust(spark, sf_dir):
    """Cameras and points off their places, adjusted together: without noise every point is again seen where it was
    observed, to a hundredth of a pixel, by the adjusted cameras."""
    seen = written(observations(spark, sf_dir).select("track_id", "image_id", "u", (-F.col("v")).alias("v")), "seen")
    several = seen.groupBy("track_id").agg(F.count("*").alias("n")).where("n > 1")
    points = _shifted(spark, sf_dir).join(several, "track_id", "left_semi").select("track_id", "X", "Y", "Z")
    cameras, points, _ = adjust.bundle(_looking_down(spark, sf_dir), points, seen.join(several, "track_id", "left_semi"), turns=30)
    turn = mat.rotation([F.col(c) for c in QWXYZ])
    both = seen.join(points, "track_id").join(F.broadcast(cameras), "image_id")
    du, dv = geo.residual(turn, [F.col(c) for c in ("cx", "cy", "cz")], tuple(F.col(c) for c in ("fx", "fy", "px", "py")), [F.col(c) for c in "XYZ"], F.col("u"), F.col("v"))
    return triangulate.rmse(both.withColumn("du", du).withColumn("dv", dv)).select("track_id", "n_views", r("rmse", 2).alias("rmse"))


@query(f"""SELECT track_id, {rs("sqrt(X * X + Y * Y)")} AS planar, {rs("sqrt(X * X + Y * Y + Z * Z)")} AS spatial, {rs("(2 * X + 3) / (Z + 4)")} AS hx, {rs("(Y - 1) / (Z + 4)")} AS hy,
{rs("X / nullif(Z, 0)")} AS ux, {rs("X + Y - Z")} AS total FROM ({view_sql("scene_points")}) p""")
def point_algebra(spark, sf_dir):
    p = [F.col(c) for c in "XYZ"]
    h = mat.dehomogenise(mat.apply(mat.matrix([[2, 0, 0, 3], [0, 1, 0, -1], [0, 0, 1, 4]]), p))
    total = mat.total(mat.subtract(mat.add(p, [0.0] * 3), [0.0, 0.0, 2 * F.col("Z")]))
    return view(spark, sf_dir, "scene_points").select("track_id", *named([geo.hypot(*p[:2]), geo.hypot(*p), *h, mat.dehomogenise(p)[0], total], ["planar", "spatial", "hx", "hy", "ux", "total"]))


# ---------------------------------------------------------------- polygons, pixels, mosaic

BOXES = f"""bx AS ({view_sql("boxes")}),
bp AS (SELECT a.box_id AS a_id, b.box_id AS b_id, greatest(least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0), 0) AS common,
  a.w * a.h + b.w * b.h AS areas FROM bx a JOIN bx b ON b.box_id BETWEEN a.box_id + 1 AND a.box_id + 3)"""


def _box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = view(spark, sf_dir, "boxes")
    side = lambda k: boxes.select(*(F.col(c).alias(f"{k}_{c}") for c in ("box_id", "x0", "y0", "w", "h")))
    return side("a").withColumn("b_box_id", F.explode(F.sequence(F.col("a_box_id") + 1, F.col("a_box_id") + 3))).join(side("b"), "b_box_id")


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt over all cores before they are clipped: their tables are so small that a single task would read them."""
    return pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism)


def _rectangle(k: str) -> Column:
    x, y, w, h = (F.col(f"{k}_{c}") for c in ("x0", "y0", "w", "h"))
    return F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))


@query(f"WITH {BOXES} SELECT a_id, b_id, {rs('common / (areas - common)')} AS iou FROM bp")
def bbox_iou(spark, sf_dir):
    box = lambda k: tuple(F.col(f"{k}_{c}") for c in ("x0", "y0", "w", "h"))
    return _box_pairs(spark, sf_dir).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), r(polygon.box_iou(box("a"), box("b"))).alias("iou"))


@query(f"WITH {BOXES} SELECT a_id, b_id, {rs('common')} AS common, {rs('common / (areas - common)')} AS iou FROM bp")
def polygon_iou(spark, sf_dir):
    a, b = _rectangle("a"), _rectangle("b")
    pairs = _box_pairs(spark, sf_dir).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), a.alias("a"), b.alias("b"))
    both = _spread(pairs).withColumn("c", polygon.intersection("a", "b")).withColumn("iou", polygon.convex_iou("a", "b"))
    return both.select("a_id", "b_id", r(F.when(F.size("c") > 2, polygon.area(F.col("c"))).otherwise(0.0)).alias("common"), r("iou").alias("iou"))


#: Boxes turned about their middle; common points are the corners of each inside the other and the crossings of sides.
TURNED_BOXES = f"""tb AS (SELECT box_id, x0 + w / 2 AS mx, y0 + h / 2 AS my, w / 2 AS hw, h / 2 AS hh, cos(box_id * CAST(0.37 AS DOUBLE)) AS c, sin(box_id * CAST(0.37 AS DOUBLE)) AS s FROM ({view_sql("boxes")}) b),
co AS (SELECT box_id, k, mx + kx * hw * c - ky * hh * s AS x, my + kx * hw * s + ky * hh * c AS y FROM tb, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) v(k, kx, ky)),
si AS (SELECT p.box_id, p.k, p.x, p.y, q.x - p.x AS dx, q.y - p.y AS dy FROM co p JOIN co q ON q.box_id = p.box_id AND q.k = (p.k + 1) % 4),
bp AS (SELECT a.box_id AS a_id, b.box_id AS b_id, 4 * a.hw * a.hh + 4 * b.hw * b.hh AS areas FROM tb a JOIN tb b ON b.box_id BETWEEN a.box_id + 1 AND a.box_id + 3),
cr AS (SELECT a_id, b_id, p.x, p.y, p.dx, p.dy, ((q.x - p.x) * q.dy - (q.y - p.y) * q.dx) / nullif(p.dx * q.dy - p.dy * q.dx, 0) AS t, ((q.x - p.x) * p.dy - (q.y - p.y) * p.dx) / nullif(p.dx * q.dy - p.dy * q.dx, 0) AS u
  FROM bp JOIN si p ON p.box_id = a_id JOIN si q ON q.box_id = b_id),
ins AS (SELECT a_id, b_id, co.x, co.y FROM bp JOIN co ON co.box_id = a_id JOIN tb ON tb.box_id = b_id WHERE abs((x - mx) * c + (y - my) * s) <= hw AND abs((y - my) * c - (x - mx) * s) <= hh
  UNION ALL SELECT a_id, b_id, co.x, co.y FROM bp JOIN co ON co.box_id = b_id JOIN tb ON tb.box_id = a_id WHERE abs((x - mx) * c + (y - my) * s) <= hw AND abs((y - my) * c - (x - mx) * s) <= hh
  UNION ALL SELECT a_id, b_id, x + t * dx, y + t * dy FROM cr WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
an AS (SELECT *, atan2(y - avg(y) OVER g, x - avg(x) OVER g) AS turn FROM ins WINDOW g AS (PARTITION BY a_id, b_id)),
nx AS (SELECT a_id, b_id, x, y, coalesce(lead(x) OVER g, first(x) OVER g) AS x2, coalesce(lead(y) OVER g, first(y) OVER g) AS y2 FROM an WINDOW g AS (PARTITION BY a_id, b_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cm AS (SELECT a_id, b_id, abs(sum(x * y2 - x2 * y)) / 2 AS common FROM nx GROUP BY a_id, b_id)"""


@query(f"WITH {TURNED_BOXES} SELECT a_id, b_id, {rs('coalesce(common, 0)', 4)} AS common, {rs('coalesce(common, 0) / (areas - coalesce(common, 0))', 4)} AS iou FROM bp LEFT JOIN cm USING (a_id, b_id)")
def polygon_iou_turned(spark, sf_dir):
    def turned(k: str) -> Column:
        x, y, w, h = (F.col(f"{k}_{c}") for c in ("x0", "y0", "w", "h"))
        t = F.col(f"{k}_box_id") * 0.37
        corner = lambda i, j: F.struct((x + w / 2 + i * w / 2 * F.cos(t) - j * h / 2 * F.sin(t)).alias("x"), (y + h / 2 + i * w / 2 * F.sin(t) + j * h / 2 * F.cos(t)).alias("y"))
        return F.array(*(corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))))

    pairs = _box_pairs(spark, sf_dir).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), turned("a").alias("a"), turned("b").alias("b"))
    both = _spread(pairs).withColumn("c", polygon.intersection("a", "b")).withColumn("iou", polygon.convex_iou("a", "b"))
    return both.select("a_id", "b_id", r(F.when(F.size("c") > 2, polygon.area(F.col("c"))).otherwise(0.0), 4).alias("common"), r("iou", 4).alias("iou"))


#: A quadrilateral whose second corner moves in until it is no longer convex.
QUAD = [("x0", "y0"), ("x0 + w - box_id % 4", "y0 + box_id % 3"), ("x0 + w", "y0 + h"), ("x0", "y0 + h")]


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").selectExpr("box_id", "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in QUAD) + ") AS q")


QUAD_SQL = f"qd AS (SELECT box_id, {', '.join(f'{x} AS x{i + 1}, {y} AS y{i + 1}' for i, (x, y) in enumerate(QUAD))} FROM ({view_sql('boxes')}) b)"
TURNS = [f"((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}))" for a, b, c in ((1, 2, 3), (2, 3, 4), (3, 4, 1), (4, 1, 2))]


@query(f"WITH {QUAD_SQL} SELECT box_id, {rs('abs((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2')} AS area FROM qd")
def polygon_area(spark, sf_dir):
    return _quads(spark, sf_dir).select("box_id", r(polygon.area(F.col("q"))).alias("area"))


@query(f"WITH {QUAD_SQL} SELECT box_id, least({', '.join(TURNS)}) >= 0 OR greatest({', '.join(TURNS)}) <= 0 AS convex FROM qd")
def convexity(spark, sf_dir):
    return _quads(spark, sf_dir).select("box_id", polygon.is_convex(F.col("q")).alias("convex"))


@query(f"""WITH {QUAD_SQL} SELECT box_id, least(x1, x2, x3, x4) AS x, least(y1, y2, y3, y4) AS y, greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS width,
greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS height, {rs("(x1 + x2 + x3 + x4) / 4")} AS mean_x, {rs("(y1 + y2 + y3 + y4) / 4")} AS mean_y FROM qd""")
def bounding_rect(spark, sf_dir):
    q = _quads(spark, sf_dir).select("box_id", geo.bounding(F.col("q")).alias("b"), geo.centroid(F.col("q")).alias("c"))
    return q.select("box_id", "b.x", "b.y", "b.width", "b.height", r("c.x").alias("mean_x"), r("c.y").alias("mean_y"))


@query(f"""SELECT box_id, {rs("10 / w")} AS m0, 0.0 :: DOUBLE AS m1, {rs("-x0 * 10 / w")} AS m2, 0.0 :: DOUBLE AS m3, {rs("20 / h")} AS m4, {rs("-y0 * 20 / h")} AS m5,
{rs("10 / w * (x0 + 1) - x0 * 10 / w")} AS tx FROM ({view_sql("boxes")}) b""")
def homography_points(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    points = lambda *ps: F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ps))
    src = points((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    o, a, b = F.lit(0.0), F.lit(10.0), F.lit(20.0)
    m = view(spark, sf_dir, "boxes").withColumn("m", raster.homography_of(src, points((o, o), (a, o), (a, b), (o, b))))
    at = [[F.col("m")[3 * i + j] for j in range(3)] for i in range(3)]
    moved = mat.dehomogenise(mat.apply(at, [x + 1, y]))
    return m.select("box_id", *(r(F.col("m")[i]).alias(f"m{i}") for i in range(6)), r(moved[0]).alias("tx"))


@query(f"""SELECT x, y, CASE WHEN (mask0 & mask1) > 0 THEN CAST(floor(CAST(base + warped AS DOUBLE) / 2 + 0.5) AS BIGINT) WHEN ((~mask0) & mask1) > 0 THEN warped ELSE base END AS value,
CAST(mask0 | mask1 AS INTEGER) AS mask FROM ({view_sql("pixels")}) p""")
def mask_blend(spark, sf_dir):
    value = raster.pixel(F.col("base"), F.col("mask0"), F.col("warped"), F.col("mask1"))
    return view(spark, sf_dir, "pixels").select("x", "y", value.cast("long").alias("value"), F.col("mask0").bitwiseOR(F.col("mask1")).cast("int").alias("mask"))


MOSAIC = f"me AS (SELECT DISTINCT * FROM ({view_sql('mosaic_edges')}) e)"


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mosaic_edges").distinct()


@query(f"WITH {MOSAIC} SELECT src, count(*) FILTER (WHERE priority = 0) AS degree FROM me GROUP BY src")
def mosaic_degree(spark, sf_dir):
    return mosaic.out_degree(_placements(spark, sf_dir))


@query(f"WITH {MOSAIC}, g AS (SELECT src, count(*) FILTER (WHERE priority = 0) AS degree FROM me GROUP BY src) SELECT src, degree FROM g WHERE degree > 0 ORDER BY degree DESC, src LIMIT 1")
def mosaic_hub(spark, sf_dir):
    return mosaic.hub(_placements(spark, sf_dir))


@query(f"""WITH {MOSAIC}, co AS (SELECT * FROM (VALUES (0, 0), (39, 0), (39, 29), (0, 29)) c(px, py)),
al AS (SELECT src, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y FROM me, co UNION ALL
  SELECT src, CASE WHEN px + dx >= 0 THEN ceil(px + dx) ELSE floor(px + dx) END, CASE WHEN py + dy >= 0 THEN ceil(py + dy) ELSE floor(py + dy) END FROM me, co)
SELECT src, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) - min(x) + 1 AS BIGINT) AS width, CAST(max(y) - min(y) + 1 AS BIGINT) AS height FROM al GROUP BY src""")
def mosaic_bbox(spark, sf_dir):
    return mosaic.canvas_box(_placements(spark, sf_dir), 40, 30).select("src", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "width", "height")))


@query(f"""WITH {MOSAIC}, wy AS (SELECT a.src, b.dst, b.priority, a.dst AS mid, a.dx + b.dx AS dx, a.dy + b.dy AS dy FROM me a JOIN me b ON b.src = a.dst WHERE a.src <> b.dst
  AND NOT EXISTS (SELECT 1 FROM me c WHERE c.src = a.src AND c.dst = b.dst))
SELECT src, dst, mid, dx, dy, priority + 1 AS priority FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY priority, mid, dx, dy) AS k FROM wy) z WHERE k = 1""")
def mosaic_two_hop(spark, sf_dir):
    return mosaic.two_hop(_placements(spark, sf_dir))


#: Turned, scaled and slightly tilted placements from the shifts.
TILT = ["1 + src % 7 * CAST(0.01 AS DOUBLE)", "dst % 5 * CAST(0.02 AS DOUBLE)", "dx", "-(src % 5) * CAST(0.02 AS DOUBLE)", "1 + dst % 3 * CAST(0.01 AS DOUBLE)", "dy", "src % 3 * CAST(0.001 AS DOUBLE)", "dst % 4 * CAST(0.001 AS DOUBLE)", "CAST(1 AS DOUBLE)"]
COMPOSED = ", ".join(rs(" + ".join(f"b.m{3 * i + k} * a.m{3 * k + j}" for k in range(3))) + f" AS m{3 * i + j}" for i in range(3) for j in range(3))


@query(f"""WITH {MOSAIC}, mm AS (SELECT src, dst, priority, {", ".join(f"{e} AS m{i}" for i, e in enumerate(TILT))} FROM (SELECT src, dst, min(priority) AS priority, min(dx) AS dx, min(dy) AS dy FROM me GROUP BY src, dst) u),
wy AS (SELECT a.src, b.dst, a.dst AS mid, b.priority + 1 AS priority, {COMPOSED}, row_number() OVER (PARTITION BY a.src, b.dst ORDER BY b.priority, a.dst) AS k
  FROM mm a JOIN mm b ON b.src = a.dst WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM mm c WHERE c.src = a.src AND c.dst = b.dst))
SELECT * EXCLUDE (k) FROM wy WHERE k = 1""")
def mosaic_compose(spark, sf_dir):
    one = _placements(spark, sf_dir).groupBy("src", "dst").agg(*(F.min(c).alias(c) for c in ("priority", "dx", "dy")))
    placed = one.select("src", "dst", "priority", F.expr(f"array({', '.join(TILT)})").alias("m"))
    return mosaic.two_hop_matrices(placed).select("src", "dst", "mid", "priority", *(r(F.col("m")[i]).alias(f"m{i}") for i in range(9)))


@query(f"""WITH n AS (SELECT count(*) AS n FROM ({view_sql("images")}) i)
SELECT part, CAST(part * (n // 7) + least(part, n % 7) AS BIGINT) AS start, CAST((part + 1) * (n // 7) + least(part + 1, n % 7) AS BIGINT) AS stop FROM n, (SELECT CAST(range AS BIGINT) AS part FROM range(7)) k""")
def range_partition(spark, sf_dir):
    return ranges.ranges(spark, view(spark, sf_dir, "images").agg(F.count("*").alias("n")), "n", 7)
