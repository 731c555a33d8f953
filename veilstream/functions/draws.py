"""Random draws that depend on the event and the operator alone, not on partitions or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 of salt, duplication path and sequence number."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), F.col("dup_path"), F.col("seq").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def gaussian(salt: str) -> Column:
    """Standard normal by Box and Muller, from two uniform draws."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(salt + "/r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(salt + "/a"))
