"""Amounts beyond 38 digits: decimal strings priced with exact 256-bit integers, in Arrow batches.

Built-in types stop at 38 digits; where amounts fit a BIGINT, waymark.functions.pricing stays in the JVM and is to be preferred.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

LIMIT = 1 << 256


@F.pandas_udf("string")
def constant_product_wide(amount: pd.Series, r_in: pd.Series, r_out: pd.Series, fee_bps: pd.Series) -> pd.Series:
    """The floor of the constant-product output; null where an operand is null, a divisor zero, or a product beyond 256 bits."""

    def one(a: str | None, i: str | None, o: str | None, f: int | None) -> str | None:
        if a is None or i is None or o is None or f is None:
            return None
        kept = int(a) * (10_000 - int(f))
        over, under = kept * int(o), int(i) * 10_000 + kept
        return None if under <= 0 or over >= LIMIT or under >= LIMIT else str(over // under)

    return pd.Series([one(*x) for x in zip(amount, r_in, r_out, fee_bps, strict=True)])
