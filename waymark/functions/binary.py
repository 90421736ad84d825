"""Binary words and packed routes as SQL expressions over hexadecimal text: exact decimals, no Python."""

from __future__ import annotations

#: The event's signature hash, and the tag byte of each venue in a packed route.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TAGS = {"v2": 0, "v3": 1, "pancake": 2, "slipstream": 3, "solidly": 4, "balancer": 5, "curve": 6, "curve_crypto": 7, "curve_crypto_ng": 8}


def bare(text: str) -> str:
    """Hexadecimal digits without 0x, in small letters."""
    return f"lower(CASE WHEN startswith({text}, '0x') THEN substring({text}, 3) ELSE {text} END)"


def is_hex(text: str) -> str:
    return f"({bare(text)} RLIKE '^([0-9a-f]{{2}})*$')"


def number(digits: str) -> str:
    """The value of up to 16 hexadecimal digits as a decimal."""
    return f"CAST(conv({digits}, 16, 10) AS DECIMAL(38, 0))"


def word_value(word: str) -> str:
    """The value of 64 hexadecimal digits as DECIMAL(38, 0); null where 38 digits don't hold it."""
    part = lambda i: f"substring({word}, {1 + 16 * i}, 16)"
    low = f"try_add(try_multiply({number(part(2))}, 18446744073709551616BD), {number(part(3))})"
    return f"CASE WHEN {part(0)} = repeat('0', 16) AND {part(1)} = repeat('0', 16) THEN CAST({low} AS DECIMAL(38, 0)) END"


def address_of(word: str) -> str:
    """The last 20 bytes of a word, as 0x and 40 digits."""
    return f"concat('0x', right({bare(word)}, 40))"


def padded(value: str, size: int) -> str:
    """A whole number as so many bytes of hexadecimal digits, the largest first."""
    return f"lpad(lower(hex({value})), {2 * size}, '0')"


def packed_route(target: str, hops: str) -> str:
    """A route's bytes: the final token (20), then for each hop a tag byte, endpoint, token in, token out (20 each) and `extra`.

    hops: array of structs with tag (int), endpoint, token_in, token_out (bigint) and extra (hexadecimal digits, maybe empty).
    """
    hop = f"concat({padded('h.tag', 1)}, {padded('h.endpoint', 20)}, {padded('h.token_in', 20)}, {padded('h.token_out', 20)}, h.extra)"
    return f"unhex(concat({padded(target, 20)}, array_join(transform({hops}, h -> {hop}), '')))"
