"""Normal forms of ids that arrive in other letter case or padded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_id(column: Column | str) -> Column:
    """Lower case without outer blanks; null for a null or blank id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))
