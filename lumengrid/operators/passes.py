"""Small sides that tasks hold as a whole, in passes of a checked size."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: What one pass may bring to the driver and to every executor.
MOST_ROWS, MOST_BYTES = 20_000, 32_000_000


def passes(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Iterator[list[Row]]:
    """All of ``rows``, in as many lists as their counted size asks for (by hash, so with some slack below the bounds). An
    operator that holds one list a pass stays in bounds at any number of rows, and gives the same result as with one list."""
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in rows.columns), F.lit(0)))
    counted = rows.agg(F.count("*").alias("n"), size.alias("bytes")).first()
    parts = math.ceil(max(counted["n"] / most_rows, (counted["bytes"] or 0) / most_bytes))
    if parts <= 1:
        if counted["n"]:
            yield rows.collect()
        return
    parts = math.ceil(1.2 * parts)
    number = F.pmod(F.xxhash64(*(f"`{c}`" for c in rows.columns)), F.lit(parts))
    for part in range(parts):
        found = rows.where(number == part).collect()
        if found:
            yield found
