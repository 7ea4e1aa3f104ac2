"""Schema definitions as JSON documents."""

from __future__ import annotations

import json

from ..errors import StructureError
from ..operators.evolution import Evolution, evolve
from ..schema import Schema

# Fixed value: version mark of the exchange format.
STRUCT_VERSION = "2016-03-21"


def to_json(schema: Schema) -> str:
    columns = [
        {
            "colref": c.colref,
            "ismulti": c.multi,
            "isenabled": c.enabled,
            "sort": c.sort,
            "label": c.label,
            "class": c.type.name,
            "config": c.type.config,
        }
        for c in schema.columns
    ]
    document = {
        "structversion": STRUCT_VERSION,
        "schema": schema.name,
        "id": str(schema.id),
        "user": schema.user,
        "config": schema.config,
        "columns": columns,
    }
    return json.dumps(document, indent=4, ensure_ascii=False)


def from_json(text: str, ts: int, name: str | None = None, old: Schema | None = None) -> Evolution:
    """Next version of a schema from a document; columns with a known ``colref`` are updates."""
    try:
        document = json.loads(text)
    except json.JSONDecodeError as error:
        raise StructureError(f"not a JSON document: {error}") from error
    known = len(old.columns) if old else 0
    updates, new = {}, []
    for item in document["columns"]:
        if item.get("colref") and int(item["colref"]) <= known:
            updates[int(item["colref"])] = item
        else:
            new.append(item)
    table = name or document["schema"]
    return evolve(old, table, updates, new, ts, document.get("user", ""), document.get("config") or {})
