"""Merkle roots over ordered id lists, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merkle_root(ids: Column) -> Column:
    """SHA-256 of each id, neighbours hashed together level by level, an odd tail carried up unhashed."""

    def digest(data: Column) -> Column:
        return F.unhex(F.sha2(data, 256))

    def level_up(level: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.greatest((F.size(level) / 2).cast("int") - 1, F.lit(0))),
            lambda j: digest(F.concat(level[j * 2], level[j * 2 + 1])),
        )
        tail = F.slice(level, F.size(level), F.lit(1))
        return F.when(F.size(level) <= 1, level).when(F.size(level) % 2 == 1, F.concat(pairs, tail)).otherwise(pairs)

    leaves = F.transform(ids, lambda i: digest(F.encode(i, "UTF-8")))
    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(ids))).cast("int"), F.lit(1)))
    top = F.aggregate(rounds, leaves, level_up)
    return F.when(F.size(ids) == 0, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex(F.element_at(top, 1))))
