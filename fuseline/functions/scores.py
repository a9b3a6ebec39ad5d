"""Scores of pairs and candidates as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, CAP, SOFTEN = 1000.0, 100.0, 0.1


def coupling(count: Column, length: Column, d: Column) -> Column:
    """min(1000 (count / length) / (distance + 0.1), 100)."""
    return F.least((count / length) / (d + SOFTEN) * SCALE, F.lit(CAP))


def by_entropy(count: Column, link: Column, entropy: Column) -> Column:
    return count * link * (1.0 / (entropy + SOFTEN))


def by_frequency(count: Column, link: Column) -> Column:
    return count * link


def by_phi(count: Column, link: Column, gain: Column, entropy: Column | None = None) -> Column:
    h = F.lit(1.0) if entropy is None else entropy
    return count * link * (1.0 / (h + SOFTEN)) * F.greatest(F.lit(0.0), gain + 0.1)


def candidate(count: Column, link: Column, gain: Column, efficiency: Column) -> Column:
    """Score of a token candidate."""
    return count * link * (1.0 + gain) * efficiency


def attention(d: Column) -> Column:
    """1 at distance 0, falling to 0 at pi/2."""
    return F.greatest(F.lit(0.0), 1.0 - d / (math.pi / 2))
