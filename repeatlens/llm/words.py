"""Texts as arrays of code points, for scans of all their words at once."""

from __future__ import annotations

import unicodedata

import numpy as np

_PLANE = 1 << 16
# Marks that choose how a sign looks and belong to no word.
_VARIATION = (range(0x180B, 0x1810), range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0))


def _kind(point: int) -> int:
    """1 for letters, 2 for numbers, 3 for marks that belong to words, else 0."""
    category = unicodedata.category(chr(point))
    if category[0] in "LN":
        return 1 if category[0] == "L" else 2
    return 3 if category in ("Mn", "Mc") and not any(point in r for r in _VARIATION) else 0


def _table() -> tuple[np.ndarray, np.ndarray]:
    kind = np.fromiter(map(_kind, range(_PLANE)), np.uint8, _PLANE)
    lower = np.arange(_PLANE, dtype=np.uint32)
    for c in np.flatnonzero(kind == 1).tolist():
        if len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    return kind, lower


_TABLES: list = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first plane: what ``_kind`` says; the small letter."""
    if not _TABLES:
        _TABLES.extend(_table())
    return _TABLES[0], _TABLES[1]


def code_points(text: str) -> np.ndarray:
    """Code points in lower case, one for one. Those beyond the first plane stay."""
    _, lower = tables()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) and raw.max() >= _PLANE:
        return np.where(raw < _PLANE, lower[np.minimum(raw, _PLANE - 1)], raw)
    return lower[raw]


def _known(points: np.ndarray) -> np.ndarray:
    kind, _ = tables()
    if not len(points) or points.max() < _PLANE:
        return kind[points]
    out = kind[np.minimum(points, _PLANE - 1)]
    far = np.flatnonzero(points >= _PLANE)
    seen, place = np.unique(points[far], return_inverse=True)
    out[far] = np.fromiter(map(_kind, seen.tolist()), np.uint8, len(seen))[place]
    return out


def kinds(points: np.ndarray) -> np.ndarray:
    """1 for letters and their marks, 2 for numbers, else 0."""
    known = _known(points)
    return np.where(known == 3, 1, known)


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters (category L)."""
    return _known(points) == 1
