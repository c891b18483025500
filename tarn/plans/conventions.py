"""What a project adds to builds and searches: which documents count, how they change, how queries are rewritten, defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGED = ("metadata", "reranker")


@dataclass
class Conventions:
    """``include``: a predicate on columns, or a function of the path; ``transform``: a DataFrame function that may drop rows
    and change all columns but relative_path; ``rewrite``: a function of the query; ``profile``: default search options."""

    include: Column | Callable[[str], bool] | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    rewrite: Callable[[str], str] | None = None
    profile: dict[str, Any] = field(default_factory=dict)

    def documents(self, docs: DataFrame) -> DataFrame:
        """Documents that count, as they are to be indexed. Paths that ``transform`` makes up are an error; source paths stay."""
        if self.include is not None:
            if isinstance(self.include, Column):
                docs = docs.where(self.include)
            else:
                docs = docs.where(F.udf(self.include, "boolean")(F.col("relative_path")))
        if self.transform is None:
            return docs
        changed = self.transform(docs)
        made_up = changed.select("relative_path").join(docs.select("relative_path"), "relative_path", "left_anti").head(1)
        if made_up:
            raise ValueError(f"relative_path must not change: {made_up[0][0]}")
        if "source_path" in docs.columns:
            changed = changed.drop("source_path").join(docs.select("relative_path", "source_path"), "relative_path")
        return changed

    def apply(self, query: str, given: dict[str, Any]) -> tuple[str, dict[str, Any]]:
        """The rewritten query, and options: those given, then the profile's; metadata and reranker merge by key."""
        if self.rewrite is not None:
            query = self.rewrite(query)
        return query, merge_options(self.profile, given)


def merge_options(profile: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    merged = dict(profile) | {k: v for k, v in given.items() if v is not None}
    for name in _MERGED:
        a, b = profile.get(name), given.get(name)
        if a is not None and b is not None:
            a, b = ({"kind": x} if isinstance(x, str) else x for x in (a, b))
            merged[name] = {**a, **b}
    return merged


def dropped_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path) of documents that conventions leave out: an update has to remove them."""
    return before.select("relative_path").join(after.select("relative_path"), "relative_path", "left_anti")
