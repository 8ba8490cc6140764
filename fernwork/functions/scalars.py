"""The scalar functions that queries may call; each is a built-in of Spark, so it stays inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x, d=None: F.round(x) if d is None else F.round(x, d), "sqrt": F.sqrt, "ln": F.ln, "exp": F.exp, "power": F.pow, "sign": F.signum,
    "greatest": F.greatest, "least": F.least, "coalesce": F.coalesce, "nullif": F.nullif,
    "lower": F.lower, "upper": F.upper, "length": F.length, "trim": F.trim, "concat": F.concat, "substring": lambda x, at, many=None: F.substring(x, at, 2**31 - 1 if many is None else many), "replace": F.replace, "contains": F.contains, "startswith": F.startswith, "endswith": F.endswith,
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "date": F.to_date, "to_date": F.to_date, "date_trunc": F.date_trunc, "now": F.current_timestamp, "current_timestamp": F.current_timestamp,
}

#: Functions over windows, beside the aggregates.
WINDOWS: dict[str, Callable[..., Column]] = {
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist, "ntile": F.ntile,
    "lag": F.lag, "lead": F.lead, "first_value": F.first, "last_value": F.last,
}
