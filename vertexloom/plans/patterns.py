"""Patterns of vertices and edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class PatternEdge:
    """``source`` and ``target`` are variables; ``direction`` is OUT (source to target) or IN (target to source)."""

    source: str
    target: str
    relations: Sequence[str]
    direction: str = "OUT"


@dataclass(frozen=True)
class Pattern:
    """``nodes``: each variable's vertex labels. Empty labels or relations match nothing."""

    nodes: Mapping[str, Sequence[str]]
    edges: Sequence[PatternEdge] = field(default_factory=tuple)

    def empty(self) -> bool:
        """Whether the pattern can be seen to match nothing."""
        named = all(e.source in self.nodes and e.target in self.nodes for e in self.edges)
        return not named or not all(self.nodes.values()) or not all(e.relations and e.direction in ("OUT", "IN") for e in self.edges)
