"""Predicates on documents: path prefix and metadata."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_prefix(prefix: str | None, column: str = "relative_path") -> Column:
    """Paths that begin with the prefix; an empty one or none lets all pass."""
    return F.lit(True) if not prefix else F.col(column).startswith(prefix)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def metadata_equals(wanted: dict[str, Any] | None, column: str = "metadata_json") -> Column:
    """Every key is there with an equal value of the same JSON kind. Numbers compare by value, lists and objects deeply."""
    test = F.lit(True)
    whole = F.try_parse_json(F.col(column))
    for key, value in (wanted or {}).items():
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        part = F.try_variant_get(whole, path, "variant")
        kind = F.schema_of_variant(part)
        if value is None:
            hit = kind == "VOID"
        elif isinstance(value, bool):
            hit = (kind == "BOOLEAN") & (F.try_variant_get(whole, path, "boolean") == F.lit(value))
        elif isinstance(value, (int, float)):
            hit = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)") & (F.try_variant_get(whole, path, "double") == F.lit(float(value)))
        elif isinstance(value, str):
            hit = (kind == "STRING") & (F.try_variant_get(whole, path, "string") == F.lit(value))
        else:
            hit = F.to_json(part) == F.lit(canonical_json(value))
        test = test & F.coalesce(part.isNotNull() & hit, F.lit(False))
    return test


def metadata_number(name: str, column: str = "metadata_json") -> Column:
    """A metadata field if it is a JSON number, else null."""
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    whole = F.try_parse_json(F.col(column))
    kind = F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(whole, path, "double"))
