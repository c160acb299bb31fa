"""Small text expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters Unicode calls white space.
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))
