"""Column names as they have to be written where Spark would read a dot as a path."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(names: Iterable[str]) -> list[str]:
    return ["`" + name.replace("`", "``") + "`" for name in names]
