"""Exceptions raised while a request is being described (never from inside a task)."""


class StructureError(ValueError):
    """A schema, column, comparator or parameter does not exist or does not fit."""
