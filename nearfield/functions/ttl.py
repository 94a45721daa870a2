"""Expiry of data points."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(now: datetime | str | Column | None) -> Column:
    """``now`` as a column; the start of the query by default."""
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def expired(now: datetime | str | Column | None = None, expires: str = "expires", enabled: str = "expire_enabled") -> Column:
    """True where expiry is enabled and strictly past; false where either is unknown."""
    return F.coalesce(F.col(enabled) & (F.col(expires) < moment(now)), F.lit(False))
