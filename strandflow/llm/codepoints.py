"""Code points of a piece of text, and tables over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from strandflow.llm import textkernels as K

#: No cased letter and no letter at all lies beyond.
TOP = 0x40000


@cache
def table(kind: Callable[[str], int], dtype: str = "bool") -> np.ndarray:
    """``kind`` of every code point below TOP; made once a process."""
    return np.array([kind(chr(c)) for c in range(TOP)], dtype)


def look_up(of: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Entries of a table; code points beyond it have that of the last one."""
    return of[np.minimum(points, TOP - 1)]


def _lower(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 else ord(c)


def is_letter(c: str) -> bool:
    return c.isalpha()


def read(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a piece and the offsets of its documents in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, K.code_points_before(data)[at]


def fold(points: np.ndarray) -> np.ndarray:
    """All cased letters in lower case."""
    return np.where(points < TOP, look_up(table(_lower, "uint32"), points), points)
