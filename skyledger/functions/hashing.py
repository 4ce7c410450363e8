"""Seeded order that any engine can reproduce: md5 of ``seed:id[:id…]``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(seed: int | str, *ids: str | Column) -> Column:
    parts = [F.lit(str(seed))] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts))


def hash_slot(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits as a number, which rises with the digest."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def hash_uniform(seed: int | str, *ids: str | Column) -> Column:
    """Uniform number in (0, 1) made from 32 bits of the digest."""
    bits = F.conv(F.substring(seeded_hash(seed, *ids), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / float(2**32)
