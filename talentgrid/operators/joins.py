"""Joins that do not gather a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8
_SALT = "_salt"


def join_per_key(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows per key on the left with at most one on the right.

    A key's left rows are spread over ``salts`` join keys by ``spread_by``, and its right row is copied
    to each. The result is not partitioned by the key alone, so whatever groups by the key next shuffles
    anew: its map-side combine or rank filter then works before that shuffle, and AQE stays free to
    split a skewed join partition further.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    spread, copied = left.withColumn(_SALT, salt), right.withColumn(_SALT, copies)
    return spread.join(copied, [*key, _SALT], how).drop(_SALT)
