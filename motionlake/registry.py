"""Named components that a configuration can ask for."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

CATEGORIES = ("preprocessor", "detector", "tracker", "feature", "model")
_known: dict[str, dict[str, Callable[..., Any]]] = {c: {} for c in CATEGORIES}
_parts: set[tuple[str, str]] = set()


def register(category: str, name: str, alone: bool = True) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Decorator; a taken name is a ValueError, an unknown category a KeyError.

    ``alone`` is False if what is built is of use only as parts of a saved pipeline.
    """
    if name in _known[category]:
        raise ValueError(f"{category} {name} is already registered")

    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        _known[category][name] = f
        if not alone:
            _parts.add((category, name))
        return f

    return add


def build(category: str, name: str, *args: Any, **how: Any) -> Any:
    if name not in _known[category]:
        raise KeyError(f"no {category} {name}; there are {available(category)}")
    return _known[category][name](*args, **how)


def available(category: str, alone: bool = False) -> list[str]:
    """All names, or those of components that work ``alone``."""
    return sorted(n for n in _known[category] if not (alone and (category, n) in _parts))


def is_registered(category: str, name: str) -> bool:
    return name in _known[category]
