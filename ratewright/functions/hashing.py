"""Row-keyed uniforms: the same draw on any partitioning, engine or re-run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def key_hash(key: Column | str, seed: str, *salt: Column | str) -> Column:
    """32 bits of md5 over ``key:seed[:salt...]`` as BIGINT in [0, 2**32)."""
    key = F.col(key) if isinstance(key, str) else key
    salts = [F.lit(s) if isinstance(s, str) else s for s in salt]
    text = F.concat_ws(":", key.cast("string"), F.lit(seed), *salts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(key: Column | str, seed: str, *salt: Column | str) -> Column:
    """Uniform in [0, 1) fixed by the row key; never ``rand()``, which a re-run task would redraw."""
    return key_hash(key, seed, *salt) / F.lit(float(2**HASH_BITS))
