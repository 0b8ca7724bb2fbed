"""Settings by name, from the environment or any other mapping; blank is unset."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence


class Settings:
    def __init__(self, values: Mapping[str, str] | None = None):
        self.values = os.environ if values is None else values

    def optional(self, name: str) -> str | None:
        return self.values.get(name, "").strip() or None

    def required(self, name: str) -> str:
        found = self.optional(name)
        if found is None:
            raise ValueError(f"{name} is required")
        return found

    def integer(self, name: str, default: int) -> int:
        """A whole number of 1 or more."""
        found = self.optional(name)
        try:
            number = default if found is None else float(found)
        except ValueError:
            number = 0
        if number < 1 or number != int(number):
            raise ValueError(f"{name} must be a whole number of 1 or more")
        return int(number)

    def boolean(self, name: str, default: bool) -> bool:
        return self.one_of(name, ("true", "false"), str(default).lower()) == "true"

    def one_of(self, name: str, allowed: Sequence[str], default: str) -> str:
        found = self.optional(name) or default
        if found not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        return found
