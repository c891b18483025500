"""Splitting texts into chunks that follow headings and overlap.

A heading is a line that, trimmed, begins with one to six ``#`` and has text after them; it ends the block before it and is no
part of one. Blank lines part blocks. A chunk takes blocks while their tokens stay within the target (the first is always
taken), and ends early, once half full, before a block under another heading. The next chunk begins with those last blocks
whose tokens together stay below the overlap, and at least one block on from where this one began.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import EXCERPT, py_token_count


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 512
    overlap_tokens: int = 64

    def describe(self) -> dict:
        return asdict(self)


def heading(line: str) -> tuple[int, str] | None:
    """Level and text of a heading line."""
    line = line.strip()
    text = line.lstrip("#")
    level = len(line) - len(text)
    return (level, text.strip()) if 1 <= level <= 6 and text.strip() else None


def blocks(content: str) -> list[tuple[list[str], str]]:
    """Heading path and text of each block."""
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    out, path, held = [], [], []

    def flush() -> None:
        text = "\n".join(held).strip()
        held.clear()
        if text:
            out.append((list(path), text))

    for line in lines:
        line = line.removesuffix("\r")
        if found := heading(line):
            flush()
            del path[found[0] - 1 :]
            path.append(found[1])
        elif line.strip():
            held.append(line)
        else:
            flush()
    flush()
    return out


def chunks(content: str, options: Chunking = Chunking()) -> list[dict]:
    """Chunks of one text; places are byte offsets."""
    parts = blocks(content)
    weight = [py_token_count(text) for _, text in parts]
    raw = content.encode()
    out, first = [], 0
    while first < len(parts):
        path, end, tokens = parts[first][0], first, 0
        while end < len(parts) and (end == first or tokens + weight[end] <= options.target_tokens):
            tokens += weight[end]
            end += 1
            if end < len(parts) and parts[end][0] and parts[end][0] != path and tokens >= options.target_tokens // 2:
                break
        text = "\n\n".join(t for _, t in parts[first:end])
        start = max(0, raw.find(parts[first][1].encode()))
        out.append(
            {
                "ordinal": len(out),
                "heading_path": path,
                "char_start": start,
                "char_end": start + len(text.encode()),
                "token_count": tokens,
                "chunk_text": text,
                "excerpt": text[:EXCERPT],
            }
        )
        back, shared = end, 0
        while back > first:
            shared += weight[back - 1]
            if shared >= options.overlap_tokens:
                break
            back -= 1
        first = max(back, first + 1)
    return out


FIELDS = "ordinal int, heading_path array<string>, char_start int, char_end int, token_count int, chunk_text string, excerpt string"
_ARROW = pa.list_(
    pa.struct(
        [("ordinal", pa.int32()), ("heading_path", pa.list_(pa.string())), ("char_start", pa.int32()), ("char_end", pa.int32()), ("token_count", pa.int32()), ("chunk_text", pa.string()), ("excerpt", pa.string())]
    )
)


def chunk_array(content: Column, options: Chunking = Chunking()) -> Column:
    """Chunks of a text column as an array of structs; none for null and blank texts."""

    @F.arrow_udf(f"array<struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(t or "", options) for t in texts.to_pylist()], _ARROW)

    return split(content)


def chunk(documents: DataFrame, options: Chunking = Chunking()) -> DataFrame:
    """(doc_id, ordinal, heading_path, char_start, char_end, token_count, chunk_text, excerpt) from (doc_id, content)."""
    return documents.select("doc_id", F.inline(chunk_array(F.col("content"), options)))
