"""Bounds of the numbers that a caller may ask for."""

from __future__ import annotations

# --- fixed values: default, least and most of each read -------------------------------------------
LIMITS = {"search": (10, 1, 50), "cases": (20, 1, 100), "recommended": (7, 1, 30), "wrong_answers": (20, 1, 100), "similar": (5, 1, 20)}


def limit_of(read: str, asked: int | None = None) -> int:
    """How many rows a read gives: its default, or what is asked for within its bounds."""
    default, least, most = LIMITS[read]
    if asked is None:
        return default
    if not least <= asked <= most:
        raise ValueError(f"{read}: {asked} is not between {least} and {most}")
    return asked


def clamped(value: int, least: int, most: int) -> int:
    return max(least, min(value, most))
