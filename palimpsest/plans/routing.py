"""Which snapshot answers for a version: decided by numbers on the driver, so that the plan reads one range of versions."""

from __future__ import annotations

from collections.abc import Iterable

from palimpsest.model import TriplePattern


def nearest_snapshot(snapshots: Iterable[int], version: int) -> int:
    """The snapshot with the fewest steps to the version; of two equally near the lower."""
    return min(snapshots, key=lambda s: (abs(s - version), s))


def index_for(pattern: TriplePattern) -> str:
    """The order in which what fits the pattern lies together: spo, pos or osp."""
    s, p, o = (x is not None for x in (pattern.s, pattern.p, pattern.o))
    if s:
        return "osp" if o and not p else "spo"
    return "pos" if p else "osp" if o else "spo"


def clamp(version: int, lowest: int, highest: int) -> int | None:
    """The version to answer for: past the end the last one, None before the first."""
    return None if version < lowest else min(version, highest)
