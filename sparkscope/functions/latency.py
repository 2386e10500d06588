"""Log-bucket latency sketch (E3, E4): mergeable counts whose percentiles are bucket midpoints, within one per cent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ratio of neighbouring bucket bounds.
GAMMA = 1.02


def bucket_index(duration_ms: Column) -> Column:
    return F.floor(F.log(F.greatest(duration_ms, F.lit(1)).cast("double")) / F.log(F.lit(GAMMA))).cast("int")


def bucket_ms(index: Column) -> Column:
    return F.pow(F.lit(GAMMA), index + F.lit(0.5))


def bucket_low_ms(index: Column) -> Column:
    return F.pow(F.lit(GAMMA), index.cast("double"))
