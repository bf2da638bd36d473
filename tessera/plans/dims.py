"""Driver-side planning over dimensions: everything here is the size of metadata."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from ..errors import ChunkShapeMismatch, InvalidShapes, NoBroadcastShape


class Dimension(NamedTuple):
    """A named size; dimensions are equal if both are."""

    name: str
    size: int


def dimensions(given: Iterable[Dimension | tuple[str, int]]) -> tuple[Dimension, ...]:
    return tuple(Dimension(str(n), int(s)) for n, s in given)


def flat_size(dims: Sequence[Dimension]) -> int:
    """Cells of an array with these dimensions; a scalar has one."""
    return math.prod(d.size for d in dims)


def strides(sizes: Sequence[int]) -> list[int]:
    """Row-major: the last dimension is contiguous."""
    out = [1] * len(sizes)
    for i in reversed(range(len(sizes) - 1)):
        out[i] = out[i + 1] * sizes[i + 1]
    return out


def compare(a: Sequence[Dimension], b: Sequence[Dimension]) -> int | None:
    """-1, 0 or 1 if a is part of, equal to or contains b; None if they don't compare.
    Only scalars and single dimensions are parts of other shapes here."""
    if tuple(a) == tuple(b):
        return 0
    low, high, sign = (a, b, -1) if len(a) < len(b) else (b, a, 1)
    if len(low) == len(high):
        return None
    return sign if not low or (len(low) == 1 and low[0] in high) else None


def place(part: Sequence[Dimension], whole: Sequence[Dimension]) -> int | None:
    """Where ``part`` first lies in ``whole`` without gaps."""
    n = len(part)
    return next((i for i in range(len(whole) - n + 1) if tuple(whole[i : i + n]) == tuple(part)), None)


def broadcast_target(shapes: Sequence[Sequence[Dimension]]) -> tuple[Dimension, ...]:
    """The longest list of dimensions, the first of equals."""
    if not shapes:
        raise NoBroadcastShape("NO_BROADCAST_SHAPE: there are no columns")
    return dimensions(max(shapes, key=len))


class Repeats(NamedTuple):
    """How often the whole is repeated, and each element within it."""

    whole: int
    each: int


def repeats(dims: Sequence[Dimension], target: Sequence[Dimension]) -> Repeats | None:
    """What expands ``dims`` to ``target``; None if that can't be."""
    dims, target = dimensions(dims), dimensions(target)
    if dims == target:
        return Repeats(1, 1)
    at = 0 if not dims else place(dims, target)
    if at is None:
        return None
    return Repeats(flat_size(target[:at]), flat_size(target[at + len(dims) :]))


def repeats_or_raise(dims: Sequence[Dimension], target: Sequence[Dimension]) -> Repeats:
    found = repeats(dims, target)
    if found is None:
        raise InvalidShapes(f"INVALID_SHAPES: {list(map(tuple, dims))} can't be expanded to {list(map(tuple, target))}")
    return found


def single_repeats(dims: Sequence[Dimension], target: Sequence[Dimension]) -> Repeats | None:
    """``repeats`` for equal shapes, scalars and single dimensions only."""
    return repeats(dims, target) if len(dims) < 2 or tuple(dims) == tuple(target) else None


def _clamped(raw: float, size: int) -> int:
    return max(1, min(int(math.floor(raw)), max(size, 1)))


def aligned_chunks(groups: Sequence[Sequence[Dimension]], target: int) -> list[tuple[Dimension, ...]]:
    """Chunk sizes near ``target`` elements for each group, equal where groups share a name.

    A group's sizes keep their ratios; if the chunk falls under half the target it is grown
    once by two, and beyond that the group is one chunk. A name then takes its least chunk.
    Double precision in this order of operations is part of the definition.
    """
    raw: list[list[int]] = []
    for group in map(dimensions, groups):
        if not group:
            raw.append([])
            continue
        largest = max(1, *(d.size for d in group))
        ratio = [d.size / largest for d in group]
        product = math.prod(ratio)
        scale = (target / product) ** (1.0 / len(group)) if product > 0 else 1.0
        found = [_clamped(r * scale, d.size) for r, d in zip(ratio, group, strict=True)]
        if math.prod(found) < target // 2:
            found = [_clamped(r * scale * 2.0, d.size) for r, d in zip(ratio, group, strict=True)]
            if math.prod(found) < target // 2:
                found = [max(1, d.size) for d in group]
        raw.append(found)
    least: dict[str, int] = {}
    for group, found in zip(groups, raw, strict=True):
        for (name, _), chunk in zip(group, found, strict=True):
            least[name] = min(least.get(name, chunk), chunk)
    return [tuple(Dimension(name, least[name]) for name, _ in group) for group in groups]


def check_chunk_shape(chunk_shape: Sequence[int]) -> list[int]:
    shape = [int(c) for c in chunk_shape]
    if any(c <= 0 for c in shape):
        raise ChunkShapeMismatch(f"CHUNK_SHAPE_MISMATCH: chunk sizes must be positive, not {shape}")
    return shape
