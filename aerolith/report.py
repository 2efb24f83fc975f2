"""Log, progress and short texts for people."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Messages that every level shows.
MESSAGE = 100
logging.addLevelName(MESSAGE, "MESSAGE")
LOG = logging.getLogger("aerolith")


def message(text: str, *args) -> None:
    LOG.log(MESSAGE, text, *args)


class Progress:
    """A counter between 0 and its total, upwards or as a countdown."""

    def __init__(self, total: int, countdown: bool = False) -> None:
        self.reset(total, countdown)

    def reset(self, total: int, countdown: bool = False) -> None:
        self.total, self.countdown = max(total, 0), countdown
        self.rerun()

    def rerun(self) -> None:
        self.current = self.total if self.countdown else 0

    def update(self, by: int = 1, current: int | None = None) -> int:
        """Move by a number of steps, or to a place; never out of range."""
        to = current if current is not None else self.current + (-by if self.countdown else by)
        self.current = min(max(to, 0), self.total)
        return self.current

    @property
    def share(self) -> float:
        return self.current / self.total if self.total else 1.0

    def __str__(self) -> str:
        done = round(20 * self.share)
        return f"[{'#' * done}{'.' * (20 - done)}] {self.current}/{self.total}"


def pose_text() -> Column:
    return F.format_string("lat %.6f, lon %.6f, altitude %.2f", "lat", "lon", "rel_alt")


def pair_text() -> Column:
    return F.format_string("%d - %d: %d matches", "img_lhs", "img_rhs", "n_matches")


def angle_text() -> Column:
    return F.format_string("yaw %.2f, pitch %.2f, roll %.2f", "yaw", "pitch", "roll")


def intrinsic_text() -> Column:
    return F.format_string("fx %.2f, fy %.2f, cx %.2f, cy %.2f", "fx", "fy", "cx", "cy")
