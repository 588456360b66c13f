"""Exact integer scores of any size: how tasks make them, and how tables order them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = -(2**63), 2**63 - 1
NINES = str.maketrans("0123456789", "9876543210")

#: The columns of a score in a table: the sign of what is beyond 64 bits, the score cut to 64 bits, and digits that sort as the score does.
SCORE = "over int, score long, digits string"


def whole(x: float, scale: int) -> int:
    """floor(scale * x) for any finite x; ``scale`` is a power of two."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def wholes(x: np.ndarray, scale: int) -> list[list[int]]:
    return [[whole(v, scale) for v in row] for row in x.tolist()]


def dot(a: list[int], b: list[int]) -> int:
    return sum(p * q for p, q in zip(a, b))


def stored(n: int) -> tuple[int, int, str]:
    if LEAST <= n <= MOST:
        return 0, n, ""
    digits = str(abs(n))
    return (1, MOST, f"{len(digits):05d}{digits}") if n > 0 else (-1, LEAST, f"{99999 - len(digits):05d}{digits.translate(NINES)}")


def loaded(over: int, score: int, digits: str) -> int:
    return score if not over else int(digits[5:]) if over > 0 else -int(digits[5:].translate(NINES))


def best_first() -> list[Column]:
    return [F.col("over").desc(), F.col("score").desc(), F.col("digits").desc()]


def within_64_bits(over: str = "over", score: str = "score") -> Column:
    """The score, or an error if 64 bits can't hold it. For rows that are returned."""
    return F.when(F.col(over) == 0, F.col(score)).otherwise(F.raise_error(F.lit("a returned score is beyond 64 bits")).cast("long"))
