"""Match filtering: threshold, greedy one-to-one, pair validity, keypoint dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.config import DEFAULT

PAIR = ["img_lhs", "img_rhs"]


def cosine(least: float) -> Callable:
    """A pair matcher by cosine similarity: every pair of features of at least ``least``. A descriptor without length
    is like nothing."""

    def match(kpts0, desc0: np.ndarray, kpts1, desc1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def unit(d):
            length = np.linalg.norm(d, axis=1, keepdims=True)
            return np.divide(d, length, out=np.zeros_like(d), where=length > 0)

        scores = unit(desc0) @ unit(desc1).T
        at = np.argwhere(scores >= least)
        return at, scores[at[:, 0], at[:, 1]]

    return match


def score_pairs(pairs: DataFrame, features: DataFrame, least: float = DEFAULT.match_score) -> DataFrame:
    """The default scorer: cosine similarity, at least ``least``, of the features of a pair's two images. An image
    without features takes its pairs with it."""
    return score_with(pairs, features, cosine(least))


def above(matches: DataFrame, score: float = DEFAULT.match_score) -> DataFrame:
    return matches.where(F.col("score") >= score)


def best_per_lhs(matches: DataFrame) -> DataFrame:
    """Of each left feature of a pair the match of highest score, ties to the lower right feature."""
    best = F.max_by(F.struct("rhs", "score"), F.struct("score", (-F.col("rhs")).alias("low")))
    return matches.groupBy(*PAIR, "lhs").agg(best.alias("m")).select(*PAIR, "lhs", "m.rhs", "m.score")


def one_to_one(matches: DataFrame) -> DataFrame:
    """Best per left feature, then best per right feature among those: a left feature that loses its right one
    has no second choice. Both steps are aggregates with map-side combination, so a feature with very many
    candidates does not gather them in one task."""
    best = F.max_by(F.struct("lhs", "score"), F.struct("score", (-F.col("lhs")).alias("low")))
    return best_per_lhs(matches).groupBy(*PAIR, "rhs").agg(best.alias("m")).select(*PAIR, "m.lhs", "rhs", "m.score")


def pair_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*PAIR).agg(F.count("*").alias("n_matches"))


def valid_pairs(matches: DataFrame, least: int = DEFAULT.matches_per_pair) -> DataFrame:
    return pair_counts(matches).where(F.col("n_matches") >= least)


def rejected_pairs(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    return pairs.join(valid, PAIR, "left_anti")


def _ends(matches: DataFrame) -> DataFrame:
    side = lambda image, index: matches.select(F.col(image).alias("image_id"), F.col(index).alias("feat_idx"), *PAIR, "lhs")
    return side("img_lhs", "lhs").union(side("img_rhs", "rhs"))


def keypoint_dictionary(matches: DataFrame, features: DataFrame) -> DataFrame:
    """``image_id, px, py, pnt_idx``: one dense id from 0 for each exact point of an image that matches use, in
    the order (pair, left feature) of its first use."""
    points = features.select("image_id", "feat_idx", F.col("x").alias("px"), F.col("y").alias("py"))
    first = _ends(matches).join(points, ["image_id", "feat_idx"]).groupBy("image_id", "px", "py").agg(F.min(F.struct(*PAIR, "lhs", "feat_idx")).alias("first"))
    order = Window.partitionBy("image_id").orderBy("first", "px", "py")
    return first.select("image_id", "px", "py", (F.row_number().over(order) - 1).cast("long").alias("pnt_idx"))


def located(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches with the coordinates of both ends: the line segments that a match drawing shows."""
    side = lambda image, index, x, y: features.select(F.col("image_id").alias(image), F.col("feat_idx").alias(index), F.col("x").alias(x), F.col("y").alias(y))
    return matches.join(side("img_lhs", "lhs", "x0", "y0"), ["img_lhs", "lhs"]).join(side("img_rhs", "rhs", "x1", "y1"), ["img_rhs", "rhs"]).select(*PAIR, "lhs", "rhs", "x0", "y0", "x1", "y1", "score")


def encoded(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches by dictionary ids."""
    ids = keypoint_dictionary(matches, features)
    side = lambda image, x, y, out: ids.select(F.col("image_id").alias(image), F.col("px").alias(x), F.col("py").alias(y), F.col("pnt_idx").alias(out))
    lines = located(matches, features)
    return lines.join(side("img_lhs", "x0", "y0", "pnt_lhs"), ["img_lhs", "x0", "y0"]).join(side("img_rhs", "x1", "y1", "pnt_rhs"), ["img_rhs", "x1", "y1"]).select(*PAIR, "pnt_lhs", "pnt_rhs", "score")


def score_with(pairs: DataFrame, features: DataFrame, matcher: Callable) -> DataFrame:
    """Raw matches of a matcher: ``matcher(kpts0, desc0, kpts1, desc1)`` gives index pairs and scores. The features of
    an image, as ``strongest`` bounds them, travel as one array, so that a pair is one row and its scores are one matrix
    product; images without any drop out. ``features`` has ``descriptor`` and, for learned matchers, ``nx, ny``."""
    points = [c for c in ("nx", "ny") if c in features.columns]
    packed = features.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("feat_idx", *points, "descriptor"))).alias("f"))
    side = lambda image, out: packed.select(F.col("image_id").alias(image), F.col("f").alias(out))
    both = pairs.select(*PAIR).join(side("img_lhs", "f0"), "img_lhs").join(side("img_rhs", "f1"), "img_rhs")

    def unpacked(cell: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = cell.flatten()
        n = len(f)
        kpts = np.column_stack([f.field(c).to_numpy(zero_copy_only=False) for c in points]) if points else np.zeros((n, 0))
        return f.field("feat_idx").to_numpy(zero_copy_only=False), kpts, f.field("descriptor").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                ids0, kpts0, desc0 = unpacked(batch.column(2).slice(k, 1))
                ids1, kpts1, desc1 = unpacked(batch.column(3).slice(k, 1))
                found, scores = matcher(kpts0, desc0, kpts1, desc1)
                found = np.asarray(found, np.int64).reshape(-1, 2)
                n = len(found)
                columns = [np.full(n, ends[0][k]), np.full(n, ends[1][k]), ids0[found[:, 0]], ids1[found[:, 1]]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.asarray(scores, float), pa.float64())], names=[*PAIR, "lhs", "rhs", "score"])

    return both.select(*PAIR, "f0", "f1").mapInArrow(run, schemas.MATCH)
