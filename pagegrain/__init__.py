"""Typed, revisioned, multi-valued page data on Spark."""

from .columns import ColumnType, register_type
from .errors import StructureError
from .plans.params import Params, bind
from .plans.search import Search, search
from .plans.spec import Filter, PageValue, SearchSpec
from .schema import Schema, SchemaColumn, column
from .session import ensure_checkpoint_dir, tune
from .store import Store

__all__ = [
    "ColumnType",
    "Filter",
    "PageValue",
    "Params",
    "Schema",
    "SchemaColumn",
    "Search",
    "SearchSpec",
    "Store",
    "StructureError",
    "bind",
    "column",
    "ensure_checkpoint_dir",
    "register_type",
    "search",
    "tune",
]
