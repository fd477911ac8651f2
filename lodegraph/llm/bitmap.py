"""A bounded membership bitmap, evaluated by Spark itself.

A join that keeps few rows of a wide table would shuffle all of it. The bitmap lets rows that are surely no match pass by;
it may let others in, never the other way round, so an exact join must follow. It has 16 bits a key within bounds; of keys
beyond them it lets every row in.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most bits; a plan holds the bits as text.
LEAST_BITS, MOST_BITS = 1 << 14, 1 << 22


def _slot(key: Column, bits: int) -> Column:
    return F.xxhash64(F.lit(7), key).bitwiseAND(F.lit(bits - 1))


def maybe_in(keys: DataFrame, name: str, bits: int | None = None) -> Column:
    """A condition on a column ``name`` that holds for every key of ``keys`` and few others."""
    if bits is None:
        bits = max(LEAST_BITS, 1 << (16 * keys.count()).bit_length())
        if bits > 4 * MOST_BITS:  # over a quarter of all bits would be set
            return F.lit(True)
        bits = min(bits, MOST_BITS)
    slot = _slot(F.col(name), bits)
    words = keys.groupBy(F.shiftrightunsigned(slot, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(xxhash64(7, `{name}`) & 31 AS INT))")).alias("on"))
    found = words.toArrow()  # at most bits / 32 rows
    on = np.zeros(bits >> 5, np.int64)
    on[found.column("word").to_numpy()] = found.column("on").to_numpy()
    table = F.from_json(F.lit(json.dumps(on.tolist())), "array<bigint>")
    word = F.get(table, F.shiftrightunsigned(slot, 5).cast("int"))
    return F.expr("CAST(1 AS BIGINT)").bitwiseAND(F.call_function("shiftright", word, slot.bitwiseAND(F.lit(31)).cast("int"))) == 1
