"""Pricing by batches, for curves that SQL can't hold; exact whole numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.pricing import REGISTRY

#: name -> function of arrays (amount, r_in, r_out, fee: object arrays of whole numbers or None) that gives outputs (None: the quote fails).
BATCH: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {}


def register_batch(name: str, quote: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> None:
    BATCH[name] = quote


def quoted(price: str, amount: str = "amount") -> Column:
    """What an edge's columns give for an amount: SQL where the price is registered as such, else a batch function over Arrow."""
    if price in REGISTRY:
        return F.expr(REGISTRY[price](amount))
    quote = BATCH[price]

    @F.pandas_udf("long")
    def run(a: pd.Series, r_in: pd.Series, r_out: pd.Series, fee: pd.Series) -> pd.Series:
        whole = [s.astype("Int64").to_numpy(dtype=object, na_value=None) for s in (a, r_in, r_out, fee)]
        return pd.Series(quote(*whole), dtype="Int64")

    return run(F.col(amount), F.col("r_in"), F.col("r_out"), F.col("fee").cast("long"))


def stable_swap(amplification: int, fee_bps: int = 4) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Two balances on the stable-swap invariant of its published paper, by Newton's steps in whole numbers, all rows of a batch at once.

    Balances and amounts below 2^19 are stepped in 64-bit arrays, others in arbitrary precision; results are the same. An edge's own fee counts
    where it has one. A row fails (None) without positive balances and amount, or where nothing is left.
    """
    ann = amplification * 2

    def steps(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
        """What remains of y when x becomes new."""
        s = x + y
        d = s.copy()
        for _ in range(255):
            p = d * d // (x * 2) * d // (y * 2)
            after = (ann * s + p * 2) * d // ((ann - 1) * d + 3 * p)
            moved, d = np.abs(after - d) > 1, after
            if not moved.any():
                break
        c = d * d // (new * 2) * d // (ann * 2)
        b = new + d // ann
        out = d.copy()
        for _ in range(255):
            after = (out * out + c) // (2 * out + b - d)
            moved, out = np.abs(after - out) > 1, after
            if not moved.any():
                break
        return out

    def quote(amount: np.ndarray, r_in: np.ndarray, r_out: np.ndarray, fee: np.ndarray) -> np.ndarray:
        ok = np.array([a is not None and i is not None and o is not None and a > 0 and i > 0 and o > 0 for a, i, o in zip(amount, r_in, r_out)], bool)
        out = np.full(len(amount), None, object)
        small = ok & np.array([bool(k) and max(a, i, o) < 2**19 for k, a, i, o in zip(ok, amount, r_in, r_out)], bool)
        for some, kind in ((small, np.int64), (ok & ~small, object)):
            if some.any():
                x, y, a = (v[some].astype(kind) for v in (r_in, r_out, amount))
                got = y - steps(x, y, x + a) - 1
                rate = np.array([fee_bps if f is None else f for f in fee[some]], kind)
                net = got - got * rate // 10_000
                out[some] = [int(n) if n > 0 and n < 2**63 else None for n in net]
        return out

    return quote


register_batch("stable_swap", stable_swap(100))
