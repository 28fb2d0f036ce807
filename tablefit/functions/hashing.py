"""A row's place in [0, 1), fixed by its key and a seed.

rand() depends on how the input happens to be split into partitions; a hash of
the key does not, so samples and splits survive a re-read, a repartition and a
recomputed task.  Each use of the hash has a name of its own: were a sample and
a split to share places, the smallest of them would all be training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablefit.functions.clean import column

HEX_DIGITS = 13  # 52 bits, the most a double holds without rounding


def unit_hash(key: str | Sequence[str], seed: int = 42, use: str = "split") -> Column:
    names = [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(column(n).cast("string"), F.lit("<null>")) for n in names]
    digest = F.md5(F.concat_ws(":", F.lit(use), F.lit(str(seed)), *parts).cast("binary"))
    number = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")
    return number / F.lit(float(16**HEX_DIGITS))
