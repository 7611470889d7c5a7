"""Layered settings on the driver: defaults, then global, then project, and where each value comes from."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any


def merged(low: Mapping[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
    """Deep merge: dicts entry by entry, all else replaced by the higher layer."""
    out = deepcopy(dict(low))
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else deepcopy(v)
    return out


def get(tree: Mapping[str, Any], path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(tree, Mapping) or part not in tree:
            return default
        tree = tree[part]
    return tree


def put(tree: dict[str, Any], path: str, value: Any) -> None:
    *above, last = path.split(".")
    for part in above:
        if not isinstance(tree.get(part), dict):
            tree[part] = {}
        tree = tree[part]
    tree[last] = value


def remove(tree: dict[str, Any], path: str) -> bool:
    """Whether there was such an entry; parents left empty go too."""
    head, _, rest = path.partition(".")
    if head not in tree:
        return False
    if not rest:
        del tree[head]
        return True
    found = isinstance(tree[head], dict) and remove(tree[head], rest)
    if found and not tree[head]:
        del tree[head]
    return found


def pruned(tree: Mapping[str, Any], base: Mapping[str, Any]) -> dict[str, Any]:
    """What differs from a base."""
    out = {}
    for k, v in tree.items():
        if isinstance(v, Mapping) and isinstance(base.get(k), Mapping):
            rest = pruned(v, base[k])
            if rest:
                out[k] = rest
        elif k not in base or base[k] != v:
            out[k] = deepcopy(v)
    return out


class Settings:
    def __init__(self, **layers: Mapping[str, Any]):
        self.layers = {k: deepcopy(dict(v)) for k, v in layers.items()}

    def effective(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for layer in self.layers.values():
            out = merged(out, layer)
        return out

    def source(self, path: str) -> str | None:
        """The highest layer that has the entry."""
        missing = object()
        return next((name for name in reversed(self.layers) if get(self.layers[name], path, missing) is not missing), None)
