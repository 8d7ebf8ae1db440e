"""Names for functions that a user adds: organisers, rules by routing key, acquirers by scheme."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable


class Registry:
    """Functions by name, looked up one by one or as one made of several."""

    def __init__(self, kind: str):
        self.kind = kind
        self._known: dict[str, Callable] = {}

    def register(self, name: str, replace: bool = False) -> Callable:
        """A decorator; a name taken is an error unless it is to be replaced."""

        def add(function: Callable) -> Callable:
            if name in self._known and not replace:
                raise ValueError(f"{self.kind} {name} is registered already")
            self._known[name] = function
            return function

        return add

    def discover(self, package: str) -> list[str]:
        """Import a package's modules, which register what they define; the names known then."""
        found = importlib.import_module(package)
        for module in pkgutil.iter_modules(found.__path__, found.__name__ + "."):
            importlib.import_module(module.name)
        return sorted(self._known)

    def resolve(self, *names: str) -> Callable:
        """The function of a name; of several names one that applies them in turn."""
        if unknown := [n for n in names if n not in self._known] or not names:
            raise KeyError(f"no {self.kind} {unknown if names else 'named'}")
        steps = [self._known[n] for n in names]

        def composite(rows, *given, **named):
            for step in steps:
                rows = step(rows, *given, **named)
            return rows

        return steps[0] if len(steps) == 1 else composite

    def resolve_scheme(self, uri: str) -> Callable:
        """The function registered for a URI's scheme."""
        return self.resolve(uri.split(":", 1)[0])


#: Organisers of knowledge (DataFrame to DataFrame), scoring rules (columns by routing key), acquirers (by URI scheme).
ORGANISERS, RULES, ACQUIRERS = Registry("organiser"), Registry("rule"), Registry("acquirer")
