"""Repeatable draws that any engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chance(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1): the first 48 bits of the MD5 of the seed and the keys, joined by bars. Null keys are skipped."""
    named = F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(named, 1, 12), 16, 10).cast("long") / float(1 << 48)
