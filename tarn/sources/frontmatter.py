"""Front matter: a YAML block between ``---`` lines at the start of a file."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"\A---\n(.+?)\n---\n(.*)\Z|\A---\r\n(.+?)\r\n---\r\n(.*)\Z", re.S)


class _Loader(yaml.SafeLoader):
    """YAML with plain scalars: dates stay text."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def _plain(value):
    """A JSON value, or ValueError for what JSON cannot say."""
    if isinstance(value, dict):
        return {_key(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, str)) or (isinstance(value, float) and value == value and abs(value) != float("inf")):
        return value
    raise ValueError("not a JSON value")


def _key(key) -> str:
    if isinstance(key, bool):
        return "true" if key else "false"
    if key is None:
        return "null"
    if isinstance(key, (str, int, float)):
        return str(key)
    raise ValueError("not a plain key")


def split(source: str) -> tuple[str, str] | None:
    """The block and the rest; None unless the file starts with a block of one line at least that a fence line ends."""
    found = _FENCE.match(source)
    if not found:
        return None
    return (found[1], found[2]) if found[1] is not None else (found[3], found[4])


def heading_title(content: str) -> str | None:
    """Text of the first line that begins with ``#``."""
    for line in content.splitlines():
        if line.strip().startswith("#"):
            return line.strip().lstrip("#").strip()
    return None


def parse(source: str, relative_path: str) -> dict:
    """title, summary, canonical_url, content and metadata_json of a file.

    Fields lifted from the block count if they are text, and are no metadata in either case. A block that is no valid map
    makes the whole file content. The title is that of the block, else of the first heading, else the file's name.
    """
    content, meta = source, {}
    if parts := split(source):
        try:
            if any(isinstance(t, (yaml.AliasToken, yaml.AnchorToken)) for t in yaml.scan(parts[0], Loader=_Loader)):
                raise ValueError("aliases are not supported")
            found = yaml.load(parts[0], Loader=_Loader)  # noqa: S506 - a safe loader
            if isinstance(found, dict):
                content, meta = parts[1], _plain(found)
        except (yaml.YAMLError, ValueError, RecursionError):
            pass
    snake, camel = meta.pop("canonical_url", None), meta.pop("canonicalUrl", None)
    title, summary = meta.pop("title", None), meta.pop("summary", None)
    url = snake if isinstance(snake, str) else camel
    return {
        "title": title if isinstance(title, str) else heading_title(content) or PurePosixPath(relative_path).stem,
        "summary": summary if isinstance(summary, str) else None,
        "canonical_url": url if isinstance(url, str) else None,
        "content": content,
        "metadata_json": json.dumps(meta, sort_keys=True, separators=(",", ":"), ensure_ascii=False),
    }


_FIELDS = ["title", "summary", "canonical_url", "content", "metadata_json"]


def parsed(source: Column, relative_path: Column) -> Column:
    """``parse`` as a struct column."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">")
    def fields(sources: pa.Array, paths: pa.Array) -> pa.Array:
        rows = [parse(s or "", p or "") for s, p in zip(sources.to_pylist(), paths.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[f] for r in rows], pa.string()) for f in _FIELDS], names=_FIELDS)

    return fields(source, relative_path)
