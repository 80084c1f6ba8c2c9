"""Interval algebra on sorted numpy arrays, over many texts laid end to end; half-open, touching counts as overlap."""

from __future__ import annotations

import numpy as np

Spans = tuple[np.ndarray, np.ndarray]
NONE: Spans = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def joined(parts: list[Spans]) -> Spans:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else NONE


def islands(spans: Spans) -> Spans:
    """What spans cover, touching ones joined, in order."""
    if not len(spans[0]):
        return NONE
    order = np.lexsort((spans[1], spans[0]))
    start, stop = spans[0][order], spans[1][order]
    reach = np.maximum.accumulate(stop)
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(start) - 1]))
    return start[first], reach[last]


def touched(spans: Spans, by: Spans) -> np.ndarray:
    """Which spans touch one of by (islands)."""
    if not len(by[0]):
        return np.zeros(len(spans[0]), bool)
    at = np.searchsorted(by[0], spans[1], "right") - 1
    return (at >= 0) & (by[1][np.maximum(at, 0)] >= spans[0])


def overlapped(spans: Spans, by: Spans) -> np.ndarray:
    """Which spans share a character with one of by (islands), or have one of length zero inside."""
    if not len(by[0]):
        return np.zeros(len(spans[0]), bool)
    at = np.searchsorted(by[0], spans[1], "left") - 1
    return (at >= 0) & (by[1][np.maximum(at, 0)] > spans[0])


def cut(runs: Spans, by: Spans) -> Spans:
    """What by (islands) leaves of runs (disjoint, in order)."""
    some = by[1] > by[0]
    by = by[0][some], by[1][some]
    at = np.concatenate((*runs, *by))
    order = np.argsort(at, kind="stable")
    level = lambda a, b: np.cumsum(np.repeat([a, -a, b, -b], [len(runs[0]), len(runs[0]), len(by[0]), len(by[0])])[order])
    at, run, held = at[order], level(1, 0), level(0, 1)
    keep = (at[:-1] < at[1:]) & (run[:-1] > 0) & (held[:-1] == 0)
    return at[:-1][keep], at[1:][keep]


def clipped(runs: Spans, spans: Spans) -> Spans:
    """The parts of runs (disjoint, in order) inside each of spans, one span after the other."""
    first, end = np.searchsorted(runs[1], spans[0], "right"), np.searchsorted(runs[0], spans[1], "left")
    n = np.maximum(end - first, 0)
    own = np.repeat(np.arange(len(n)), n)
    at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return np.maximum(runs[0][at], spans[0][own]), np.minimum(runs[1][at], spans[1][own])
