"""Schemas at stage boundaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class TableMismatch(ValueError):
    """A table is not what a stage needs: columns, types or rows."""


RAW_BARS = T.StructType(
    [T.StructField("stamp", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
# Columns of a bar table and of a trade log.
CANONICAL = [
    "timestamp_est", "timestamp_utc", "open", "high", "low", "close", "volume", "pair", "year", "month", "session",
]
TRADES = (
    "entry_bar int, exit_bar int, bars_held int, direction int, entry_price double, exit_price double,"
    " pnl_pct double, pnl_dollars double, exit_reason string"
)


def require_columns(df: DataFrame, wanted: Iterable[str] | T.StructType, what: str = "table") -> DataFrame:
    """``df``, if it has the wanted columns and, where a schema is given, their types."""
    have = {f.name: f.dataType for f in df.schema}
    types = {f.name: f.dataType for f in wanted} if isinstance(wanted, T.StructType) else dict.fromkeys(wanted)
    wrong = [f"no {n}" for n in types if n not in have]
    wrong += [f"{n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in types.items() if t and n in have and have[n] != t]
    if wrong:
        raise TableMismatch(f"{what}: {'; '.join(wrong)}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Asks Spark for one row; call only where emptiness must be refused."""
    if not df.head(1):
        raise TableMismatch(f"{what} is empty")
    return df
