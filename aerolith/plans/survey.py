"""The whole dataflow: metadata to coordinates, rectified photos, features, pairs, matches, tracks, points and cameras."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.config import DEFAULT, Config
from aerolith.functions import geo, mat
from aerolith.operators import adjust, matching, neighbours, tracks, triangulate
from aerolith.operators import features as feats
from aerolith.operators.rectify import rectified
from aerolith.report import message
from aerolith.runtime import release, written
from aerolith.sources import images as files
from aerolith.sources import models, store

#: Points are packed as image * SPAN + point.
SPAN = 1 << 32
QUATERNION = ["qw", "qx", "qy", "qz"]


def located_images(meta: DataFrame) -> DataFrame:
    return geo.with_rotation(geo.with_reference(files.image_table(meta)))


def pairs_of(images: DataFrame, k: int = DEFAULT.neighbours) -> DataFrame:
    return neighbours.proposed_pairs(neighbours.nearest(images.select(F.col("image_id").alias("id"), "x", "y"), k))


def rectified_photos(spark: SparkSession, folder: str, images: DataFrame, side: int = DEFAULT.rectified_side) -> DataFrame:
    """The photos of ``images`` on the ground plane. Photos and metadata meet by file name, which is unique in a folder;
    a photo that doesn't decode is left out."""
    pixels = files.read_pixels(spark, folder).withColumn("name", geo.path_name(F.col("origin")))
    known = images.select("image_id", geo.path_name(F.col("path")).alias("name"), F.col("width").alias("meta_width"), F.col("height").alias("meta_height"), *(f"r{i}{j}" for i in range(3) for j in range(3)))
    return rectified(pixels.join(known, "name"), side)


def matched(pairs: DataFrame, features: DataFrame, config: Config = DEFAULT, matcher: Callable | None = None) -> DataFrame:
    """One-to-one matches of the pairs that keep enough of them, by cosine similarity or a learned ``matcher``."""
    strong = feats.strongest(features, config.feature_score, config.features_per_image)
    raw = matching.score_with(pairs, strong, matcher) if matcher else matching.score_pairs(pairs, strong, config.match_score)
    found = written(matching.one_to_one(matching.above(raw, config.match_score)), "matches")
    return found.join(matching.valid_pairs(found, config.matches_per_pair).select(*matching.PAIR), matching.PAIR, "left_semi")


def linked(encoded: DataFrame) -> DataFrame:
    """Track edges of dictionary-encoded matches."""
    return tracks.edge_weights(encoded.select((F.col("img_lhs") * SPAN + F.col("pnt_lhs")).alias("a"), (F.col("img_rhs") * SPAN + F.col("pnt_rhs")).alias("b"), "score"))


def cameras_of(images: DataFrame) -> DataFrame:
    """Cameras as the adjustment takes them, from positions, angles and focal lengths; heights count downwards."""
    fx, fy, cx, cy = geo.intrinsics(F.col("width"), F.col("height"), F.col("focal"), F.coalesce("focal35", F.lit(DEFAULT.focal35_default)))
    turn = mat.quaternion(geo.rotation_columns())
    out = images.select("image_id", F.array(*turn).alias("q"), F.col("x").alias("cx"), F.col("y").alias("cy"), (-F.col("rel_alt")).alias("cz"), fx.alias("fx"), fy.alias("fy"), cx.alias("px"), cy.alias("py"))
    return out.select("image_id", *(F.col("q")[i].alias(c) for i, c in enumerate(QUATERNION)), *adjust.CAMERA[4:])


def views_of(track_nodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``track_id, image_id, u, v``: where the points of tracks were seen."""
    views = track_nodes.select("track_id", F.floor(F.col("node") / SPAN).alias("image_id"), (F.col("node") % SPAN).alias("pnt_idx"))
    return views.join(dictionary, ["image_id", "pnt_idx"]).select("track_id", "image_id", F.col("px").alias("u"), F.col("py").alias("v"))


def points_of(views: DataFrame, cameras: DataFrame) -> DataFrame:
    """Linear points of tracks from their views through the cameras' rays."""
    back = mat.transpose(mat.rotation([F.col(c) for c in QUATERNION]))
    ray = mat.apply(back, [(F.col("u") - F.col("px")) / F.col("fx"), (F.col("v") - F.col("py")) / F.col("fy"), F.lit(1.0)])
    rays = views.join(cameras, "image_id").withColumns({f"v{c}": d for c, d in zip("xyz", ray, strict=True)})
    return triangulate.linear(rays)


def reconstruct(pairs: DataFrame, features: DataFrame, cameras: DataFrame, config: Config = DEFAULT, matcher: Callable | None = None) -> dict[str, DataFrame]:
    """``matches``, ``tracks`` (one point for each image), ``points`` and ``cameras`` after the joint adjustment, and
    ``lines``, the matches' ends."""
    found = written(matched(pairs, features, config, matcher), "matched")
    dictionary = written(matching.keypoint_dictionary(found, features), "dictionary")
    nodes = written(tracks.conflict_free_tracks(linked(matching.encoded(found, features)), f"CAST(floor(node / {SPAN}) AS BIGINT)"), "tracks")
    views = written(views_of(nodes, dictionary), "views")
    start = written(points_of(views, cameras), "points")
    usable = start.where("usable").select("track_id", "X", "Y", "Z")
    cameras, points, losses = adjust.bundle(cameras, usable, views.join(usable.select("track_id"), "track_id", "left_semi"), config.solver_iterations, 1e-4)
    message("Adjusted: loss %.3f to %.3f in %d steps", losses[0], losses[-1], len(losses) - 1)
    points = points.join(start.select("track_id", "n_views"), "track_id")
    return {"matches": found, "lines": matching.located(found, features), "tracks": nodes, "points": points, "cameras": cameras}


def main(argv: list[str]) -> int:
    """``survey INPUT OUTPUT``: a folder of geotagged photos to tables of images, rejected files, features, pairs, matches,
    tracks, points and cameras, as Parquet."""
    parser = argparse.ArgumentParser(prog="survey")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--side", type=int, default=DEFAULT.rectified_side, help="longer side of a rectified photo")
    parser.add_argument("--neighbours", type=int, default=DEFAULT.neighbours)
    parser.add_argument("--least-matches", type=int, default=DEFAULT.matches_per_pair, help="matches that a pair needs")
    parser.add_argument("--match-score", type=float, default=DEFAULT.match_score, help="least score of a match")
    parser.add_argument("--steps", type=int, default=DEFAULT.solver_iterations, help="most trials of the adjustment")
    parser.add_argument("--detector", help="ONNX file of a learned detector")
    parser.add_argument("--colour", action="store_true", help="the detector takes colour planes")
    parser.add_argument("--matcher", help="ONNX file of a learned matcher")
    parser.add_argument("--pictures", action="store_true", help="also write rectified photos and masks")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if not files.exists(spark, args.input):
        print(f"{args.input} does not exist", file=sys.stderr)
        return 1
    config = replace(DEFAULT, rectified_side=args.side, neighbours=args.neighbours, matches_per_pair=args.least_matches, match_score=args.match_score, solver_iterations=args.steps)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{args.output}/{name}")
        return spark.read.schema(df.schema).parquet(f"{args.output}/{name}")

    message("[1/4] Image information")
    meta = written(files.read_metadata(spark, args.input), "metadata")
    images = keep(located_images(meta), "images")
    keep(files.rejected(meta), "rejected")
    message("[2/4] Rectified photos and features")
    photos = written(rectified_photos(spark, args.input, images, config.rectified_side), "rectified")
    if args.pictures:
        store.write_rectified(photos, f"{args.output}/rectified")
    features = keep(feats.extract(photos, models.detector(args.detector, args.colour)), "features")
    message("[3/4] Pairs and matches")
    pairs = keep(pairs_of(images, config.neighbours), "pairs")
    message("[4/4] Tracks, points and cameras")
    for name, df in reconstruct(pairs, features, cameras_of(images), config, models.matcher(args.matcher)).items():
        keep(df, name)
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
