"""Columns of numbers and words packed into binary rows, so that a shuffle moves a block's part of a partition as one row."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Numbers of blocks set aside for each task, so that block numbers differ between tasks.
BLOCKS_A_TASK = 1 << 24


@lru_cache(maxsize=1)
def squeeze() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Compressed non-negative integers, one plane of bytes after another; the first byte is the number of planes."""
    values = np.ascontiguousarray(values, dtype="<u4")
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    body = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4)[:, :planes].T)
    return bytes([planes]) + squeeze()[0].compress(body.tobytes())


def unpack(data: bytes) -> np.ndarray:
    body = np.frombuffer(squeeze()[1].decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((body.shape[1], 4), dtype=np.uint8)
    out[:, : data[0]] = body.T
    return out.view("<u4").reshape(-1)


WIRE = "key long, block long, bucket int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["key", "block", "bucket", "a", "b", "c", "d", "e"]


def wire_row(key: int, block: int, bucket: int, *parts: bytes | None) -> dict:
    return dict(zip(_NAMES, [key, block, bucket, *parts, *[None] * (5 - len(parts))]))


WIRE_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in _NAMES[3:]]])


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[0]:start[0]+size[0]], values[start[1]:...], ... in one array."""
    end = np.cumsum(size)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]
