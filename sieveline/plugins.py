"""Plugins: packages that add tools and strategies under their own prefix.

A plugin is an object with ``name``, ``activate(api)`` and, if it holds anything,
``destroy()``.
"""

from __future__ import annotations

from collections.abc import Callable

from sieveline.operators import chunking, ranking

#: What a plugin may extend, by kind.
REGISTRIES: dict[str, dict[str, Callable]] = {"chunker": chunking.STRATEGIES, "fusion": ranking.FUSIONS}


class Api:
    """What a plugin sees while it is activated."""

    def __init__(self, manager: Manager, prefix: str):
        self._manager, self._prefix = manager, prefix

    def register_tools(self, tools: dict[str, Callable]) -> None:
        """Tools, named ``prefix__name``."""
        for name, function in tools.items():
            self._manager.tools[f"{self._prefix}__{name}"] = function

    def register(self, kind: str, name: str, function: Callable) -> None:
        """A strategy of a kind of ``REGISTRIES``; a name that is taken raises."""
        key = f"{self._prefix}__{name}"
        if key in REGISTRIES[kind]:
            raise ValueError(f"{kind} {key} exists")
        REGISTRIES[kind][key] = function


class Manager:
    """Active plugins and their tools."""

    def __init__(self):
        self.tools: dict[str, Callable] = {}
        self.active: dict[str, object] = {}

    def activate(self, plugin) -> None:
        """A plugin that fails to activate leaves nothing behind."""
        if plugin.name in self.active:
            return
        self.active[plugin.name] = plugin
        try:
            plugin.activate(Api(self, plugin.name))
        except Exception:
            self.remove(plugin.name)
            raise

    def remove(self, name: str) -> None:
        """Destroy a plugin, with its tools and strategies."""
        plugin = self.active.pop(name)
        for table in (self.tools, *REGISTRIES.values()):
            for key in [k for k in table if k.startswith(f"{name}__")]:
                del table[key]
        if hasattr(plugin, "destroy"):
            plugin.destroy()
