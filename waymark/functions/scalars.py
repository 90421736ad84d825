"""Scalar functions of amounts, symbols and times as SQL expressions, and small host-side parsers."""

from __future__ import annotations

import re


def short_address(a: str) -> str:
    return f"CASE WHEN length({a}) <= 12 THEN {a} ELSE concat(substring({a}, 1, 6), '..', substring({a}, length({a}) - 3, 4)) END"


def normalized_protocol(p: str) -> str:
    """Lower case, with blanks, dashes and underscores gone."""
    return f"regexp_replace(lower(trim({p})), '[ _-]+', '')"


def sanitize_symbol(s: str) -> str:
    """Upper case letters and digits only; null where none is left."""
    return f"nullif(regexp_replace(upper({s}), '[^A-Z0-9]+', ''), '')"


def format_units(amount: str, decimals: str) -> str:
    """A non-negative whole amount with a decimal point before its last `decimals` digits, trailing zeros dropped."""
    digits = f"lpad(CAST({amount} AS STRING), greatest(CAST(length(CAST({amount} AS STRING)) AS INT), {decimals} + 1), '0')"
    whole, part = f"substring({digits}, 1, length({digits}) - {decimals})", f"regexp_replace(substring({digits}, length({digits}) - {decimals} + 1, {decimals}), '0+$', '')"
    return f"CASE WHEN {decimals} = 0 OR {part} = '' THEN {whole} ELSE concat({whole}, '.', {part}) END"


def amount_usd(amount: str, decimals: str, price: str) -> str:
    return f"CAST({amount} AS DOUBLE) / power(10D, {decimals}) * {price}"


def value_loss_bps(usd_in: str, usd_out: str) -> str:
    """By how much the output's value is under the input's, in basis points; null where the input has no value."""
    return f"CASE WHEN {usd_in} > 0 THEN greatest({usd_in} - {usd_out}, 0D) * 10000D / {usd_in} END"


def token_match_rank(symbol: str, key: str, wanted: str) -> str:
    """0 exact symbol, 1 symbol begins, 2 symbol contains, 3 key begins, 4 key contains; null without a match."""
    s, k, w = f"lower({symbol})", f"lower({key})", f"lower({wanted})"
    return f"CASE WHEN {s} = {w} THEN 0 WHEN startswith({s}, {w}) THEN 1 WHEN contains({s}, {w}) THEN 2 WHEN startswith({k}, {w}) THEN 3 WHEN contains({k}, {w}) THEN 4 END"


def deadline(block_time: str, ttl: str, most: int) -> str:
    """Block time plus ttl seconds; null unless 0 < ttl <= most."""
    return f"CASE WHEN {ttl} > 0 AND {ttl} <= {most} THEN {block_time} + {ttl} END"


def snapshot_age(now: str, then: str) -> str:
    return f"greatest({now} - {then}, 0)"


def signed_diff_bps(ours: str, theirs: str) -> str:
    return f"CASE WHEN {ours} > 0 THEN CAST({theirs} - {ours} AS DOUBLE) * 10000D / {ours} END"


def low_112(word: str) -> str:
    """The low 112 bits of a hexadecimal storage word as a decimal; a word without 0x is read alike."""
    return f"CAST(conv(substring(lpad(replace({word}, '0x', ''), 64, '0'), 49, 16), 16, 10) AS DECIMAL(38, 0)) + CAST(conv(substring(lpad(replace({word}, '0x', ''), 64, '0'), 37, 12), 16, 10) AS DECIMAL(38, 0)) * 18446744073709551616BD"


def high_112(word: str) -> str:
    """Bits 112 to 223 of a hexadecimal storage word as a decimal."""
    return f"CAST(conv(substring(lpad(replace({word}, '0x', ''), 64, '0'), 21, 16), 16, 10) AS DECIMAL(38, 0)) + CAST(conv(substring(lpad(replace({word}, '0x', ''), 64, '0'), 9, 12), 16, 10) AS DECIMAL(38, 0)) * 18446744073709551616BD"


def parse_units(text: str, decimals: int) -> int:
    """A decimal text as a whole number of the smallest unit; ValueError if it isn't one or is too precise."""
    m = re.fullmatch(r"(\d*)(?:\.(\d*))?", text.strip().replace("_", ""))
    if not m or not (m[1] or m[2]):
        raise ValueError(f"not an amount: {text!r}")
    part = (m[2] or "").rstrip("0")
    if len(part) > decimals:
        raise ValueError(f"more than {decimals} decimals: {text!r}")
    return int((m[1] or "0") + part.ljust(decimals, "0"))


def parse_integer(text: str) -> int:
    """A decimal or 0x-hexadecimal text of at most 256 bits."""
    value = int(text, 16) if text.lower().startswith("0x") else int(text)
    if not 0 <= value < 1 << 256:
        raise ValueError("out of 256 bits")
    return value
