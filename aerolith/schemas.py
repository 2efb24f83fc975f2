"""Tables of the photogrammetry dataflow."""

from __future__ import annotations

IMAGE = "image_id long, path string, width int, height int, focal double, focal35 double, yaw double, pitch double, roll double, lat double, lon double, rel_alt double, abs_alt double"
FEATURE = "image_id long, feat_idx int, x double, y double, score double, nx double, ny double, descriptor array<double>"
MATCH = "img_lhs long, img_rhs long, lhs long, rhs long, score double"
EDGE = "a long, b long, score double"
TRACK = "track_id long, node long"
CAMERA = "image_id long, cx double, cy double, cz double, fx double, fy double, px double, py double"
OBSERVATION = "track_id long, image_id long, u double, v double"
POINT = "track_id long, X double, Y double, Z double, usable boolean, n_views long"
