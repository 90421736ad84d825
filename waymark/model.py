"""Configurations with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class ConfigError(ValueError):
    """A configuration that no search can use."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class FastLane:
    """First look: the best direct edges, then two hops over ranked connectors."""

    enabled: bool = True
    max_connectors: int = 8
    direct_edges: int = 1
    leg_edges: int = 1

    def __post_init__(self) -> None:
        if self.enabled:
            _need(self.max_connectors > 0 and self.direct_edges > 0 and self.leg_edges > 0, "fast lane limits must be positive")


@dataclass(frozen=True)
class Shortlist:
    """How many ranked parallel edges a pair keeps, at first and in the refinement pass."""

    enabled: bool = False
    initial: int = 1
    refinement: int = 3

    def __post_init__(self) -> None:
        _need(self.initial > 0 and self.refinement >= self.initial, "the refinement keeps at least the initial edges")


@dataclass(frozen=True)
class Heuristic:
    """Bounds of the prefix search."""

    auto_connectors: int = 8
    min_degree: int = 6
    beam_width: int | None = 64
    parallel_edges: int = 1
    finalists: int = 16
    target_first: bool = True
    dominance: bool = True
    upper_bound: bool = True
    balance_pruning: bool = False
    fast_lane: FastLane = field(default_factory=FastLane)
    shortlist: Shortlist = field(default_factory=Shortlist)

    def __post_init__(self) -> None:
        _need(min(self.auto_connectors, self.min_degree) >= 0, "connector limits can't be negative")
        _need(min(self.beam_width or (1 if self.beam_width is None else 0), self.parallel_edges, self.finalists) > 0, "beam, edges and finalists must be positive")

    @classmethod
    def balanced(cls) -> Heuristic:
        return cls()

    @classmethod
    def latency_first(cls) -> Heuristic:
        """The same bounds, and the shortlist with its refinement pass."""
        return cls(shortlist=Shortlist(enabled=True))


@dataclass(frozen=True)
class Search:
    """Bounds of a search: hops, candidates, connectors (None: all tokens; empty: none), mode."""

    min_hops: int = 1
    max_hops: int = 3
    max_candidates: int | None = None
    connectors: tuple[int, ...] | None = None
    mode: str = "exhaustive"
    heuristic: Heuristic = field(default_factory=Heuristic)

    def __post_init__(self) -> None:
        _need(self.min_hops >= 1 and self.max_hops >= self.min_hops, "1 <= min_hops <= max_hops is needed")
        _need(self.max_candidates is None or self.max_candidates > 0, "max_candidates must be positive")
        _need(self.mode in ("exhaustive", "heuristic"), "mode is exhaustive or heuristic")

    def with_hops(self, low: int, high: int) -> Search:
        return replace(self, min_hops=low, max_hops=high)

    @classmethod
    def cycles(cls) -> Search:
        return cls(min_hops=2, max_hops=3)

    @classmethod
    def quality(cls, name: str) -> tuple[Search, str]:
        """fast, balanced or exhaustive, as (search, completion)."""
        presets = {
            "fast": (cls(mode="heuristic", heuristic=Heuristic.latency_first()), "fast_lane"),
            "balanced": (cls(mode="heuristic"), "heuristic"),
            "exhaustive": (cls(), "exhaustive"),
        }
        _need(name in presets, f"unknown quality {name}")
        return presets[name]


@dataclass(frozen=True)
class Threshold:
    """Stop or release conditions in basis points; unset ones are vacuous (true for all, false for any)."""

    confidence_bps: int | None = None
    fraction_bps: int | None = None
    every: bool = True

    def __post_init__(self) -> None:
        for v in (self.confidence_bps, self.fraction_bps):
            _need(v is None or 1 <= v <= 10_000, "basis points are 1 to 10,000")
        _need(self.confidence_bps is not None or self.fraction_bps is not None, "a policy needs a condition")


@dataclass(frozen=True)
class Streaming:
    """What a progressive search emits, and how far it goes."""

    completion: str = "exhaustive"
    top_k: int = 1
    emit_all_viable: bool = False
    stop: Threshold | None = None
    initial: Threshold | None = None

    def __post_init__(self) -> None:
        _need(self.completion in ("fast_lane", "heuristic", "exhaustive"), "unknown completion")
        _need(self.top_k > 0, "top_k must be positive")


@dataclass(frozen=True)
class QuotePolicy:
    """Caps that requests are held to (analytics.check_requests)."""

    max_hops: int = 4
    max_top_k: int = 5
    max_timeout_ms: int = 15_000
    allow_exhaustive: bool = True

    def __post_init__(self) -> None:
        _need(min(self.max_hops, self.max_top_k, self.max_timeout_ms) > 0, "caps must be positive")
