"""Pricing functions as SQL expressions: exact integer floors; null where a quote fails or would overflow."""

from __future__ import annotations

from collections.abc import Callable

#: name -> function of (amount expression, prefix of the edge's columns) that gives the output amount's expression.
REGISTRY: dict[str, Callable[[str, str], str]] = {}


def register(name: str, quote: Callable[[str, str], str]) -> None:
    REGISTRY[name] = quote


def linear(amount: str, e: str = "") -> str:
    """floor(amount * num / den); null without a rate or with a zero denominator."""
    return f"(try_multiply({amount}, {e}num) div nullif({e}den, 0))"


def constant_product(amount: str, e: str = "", keep: str = "9970") -> str:
    """The output of a constant-product pool that keeps `keep` of 10,000 parts of the input."""
    inside = f"try_multiply({amount}, CAST({keep} AS BIGINT))"
    return f"(try_multiply({inside}, {e}r_out) div nullif(try_add(try_multiply({e}r_in, 10000L), {inside}), 0))"


def pool_fee(amount: str, e: str = "") -> str:
    """Constant product with the pool's own fee in basis points (30 where it has none)."""
    return constant_product(amount, e, f"(10000 - coalesce({e}fee, 30))")


def multiplier(amount: str, e: str = "", num: int = 997, den: int = 1000) -> str:
    return f"(try_multiply({amount}, {num}L) div {den})"


for _name, _quote in (("linear", linear), ("constant_product", constant_product), ("pool_fee", pool_fee), ("multiplier", multiplier)):
    register(_name, _quote)


def min_amount_out(amount: str, bps: str) -> str:
    """The least acceptable output at a slippage in basis points: a floor that can't overflow; null where it is zero."""
    return f"nullif(({amount} div 10000) * (10000 - {bps}) + (({amount} % 10000) * (10000 - {bps})) div 10000, 0)"


def profit(amount_in: str, amount_out: str) -> str:
    return f"CASE WHEN {amount_out} > {amount_in} THEN {amount_out} - {amount_in} END"


def log2_floor(x: str) -> str:
    """floor(log2 x) of a positive integer, 0 for 0."""
    return f"CASE WHEN {x} > 0 THEN CAST(length(bin({x})) - 1 AS BIGINT) ELSE 0L END"


def gap_bps(best: str, value: str) -> str:
    """How far a value is under the best, in basis points of the best."""
    return f"CASE WHEN {best} > 0 THEN CAST(greatest({best} - {value}, 0) AS DOUBLE) * 10000.0 / {best} ELSE 0.0D END"


#: What a venue's protocol adds to an edge's liquidity score.
PROTOCOL_BONUS = {"v3": 30, "curve": 25, "balancer": 22, "v2": 10, "solidly": 10}


def protocol_bonus(protocol: str) -> str:
    return f"CASE {protocol} " + " ".join(f"WHEN '{k}' THEN {v}L" for k, v in PROTOCOL_BONUS.items()) + " ELSE 0L END"


def fee_rank(fee: str) -> str:
    return f"coalesce({fee}, {2**63 - 1}L)"
