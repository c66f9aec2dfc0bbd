"""Output shapes of the reshape codec."""

from __future__ import annotations

import math

from ..errors import GridError


def resolved(shape: tuple[int, ...], wanted) -> tuple[int, ...]:
    """Of a list of sizes, -1 (once: what is left) and lists of input dimensions to merge. The order of cells stays."""
    if not wanted:
        raise GridError("reshape: an empty shape")
    merged = [d for w in wanted if isinstance(w, (list, tuple)) for d in w]
    if any(not 0 <= d < len(shape) for d in merged) or any(b <= a for a, b in zip(merged, merged[1:], strict=False)):
        raise GridError(f"reshape: input dimensions {merged} of {len(shape)}")
    sizes = [math.prod(shape[d] for d in w) if isinstance(w, (list, tuple)) else w for w in wanted]
    if sizes.count(-1) > 1 or any(s < 1 and s != -1 for s in sizes) or any(isinstance(w, (list, tuple)) and not w for w in wanted):
        raise GridError(f"reshape: shape {wanted}")
    total, known = math.prod(shape), math.prod(s for s in sizes if s != -1)
    if -1 in sizes:
        if total % known:
            raise GridError(f"reshape: {shape} does not divide into {wanted}")
        sizes[sizes.index(-1)] = total // known
    if math.prod(sizes) != total:
        raise GridError(f"reshape: {shape} has other cells than {wanted}")
    for i, w in enumerate(wanted):
        if isinstance(w, (list, tuple)) and (math.prod(sizes[:i]) != math.prod(shape[: w[0]]) or math.prod(sizes[i + 1 :]) != math.prod(shape[w[-1] + 1 :])):
            raise GridError(f"reshape: {w} would have to move in {shape}")
    return tuple(sizes)


def resolved_grid(shape, chunks, wanted) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Array shape and chunk shape after the codec; the chunk counts of merged dimensions multiply."""
    out = resolved(tuple(chunks), wanted)
    counts = [-(-s // c) for s, c in zip(shape, chunks, strict=True)]
    per = [math.prod(counts[d] for d in w) if isinstance(w, (list, tuple)) else 1 for w in wanted]
    left = math.prod(counts) // math.prod(per)
    if left > 1:
        per[next((i for i, w in enumerate(wanted) if not isinstance(w, (list, tuple))), 0)] *= left
    return tuple(c * n for c, n in zip(out, per, strict=True)), out
