"""Embeddings: the hashing embedder, static token models from local files, cosine, and the byte form of vectors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import blake3

#: Words whose hash a Python worker keeps.
_KEPT = 500_000


@dataclass(frozen=True)
class Hashing:
    """Signed counts of words in buckets by their hash; ``digest`` is "blake3", or "sha256" for checks in SQL."""

    dimensions: int = 256
    digest: str = "blake3"

    def describe(self) -> dict:
        return {"kind": "hashing"} | asdict(self)


@dataclass(frozen=True)
class StaticModel:
    """Mean of token vectors from a local folder with tokenizer.json and vectors.npy or model.safetensors."""

    folder: str
    max_tokens: int = 512

    def describe(self) -> dict:
        return {"kind": "static"} | asdict(self)


Backend = Hashing | StaticModel


def backend_of(description: dict) -> Backend:
    rest = {k: v for k, v in description.items() if k != "kind"}
    return Hashing(**rest) if description["kind"] == "hashing" else StaticModel(**rest)


_known: dict[str, dict[str, int]] = {}


def _places(words: set[str], digest: str) -> dict[str, int]:
    """For each word twice its bucket's number, plus 1 if its sign is minus."""
    known = _known.setdefault(digest, {})
    new = list(words - known.keys())
    if len(known) + len(new) > _KEPT:
        known.clear()
        new = list(words)
    if new:
        if digest == "blake3":
            heads = blake3.digests([w.encode() for w in new])[:, :2].tolist()
        else:
            heads = [hashlib.sha256(w.encode()).digest()[:2] for w in new]
        known.update((w, 2 * h[0] + h[1] % 2) for w, h in zip(new, heads))
    return known


def hashed(texts: list[str | None], dimensions: int, digest: str = "blake3") -> np.ndarray:
    """(n, dimensions): unit vectors; zero for texts without words."""
    split = [(t or "").split() for t in texts]
    known = _places(set().union(*split), digest)
    out = np.zeros((len(texts), dimensions))
    to = np.arange(256) % dimensions
    for row, words in enumerate(split):
        if words:
            n = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=512)
            out[row] = np.bincount(to, weights=n[::2] - n[1::2], minlength=dimensions)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _read_safetensors(path: Path) -> np.ndarray:
    """The first two-dimensional tensor of a safetensors file (an 8-byte header size, a JSON header, raw data)."""
    raw = path.read_bytes()
    size = int.from_bytes(raw[:8], "little")
    header = json.loads(raw[8 : 8 + size])
    kinds = {"F32": "<f4", "F16": "<f2", "F64": "<f8"}
    for name, entry in header.items():
        if name != "__metadata__" and len(entry["shape"]) == 2:
            a, b = entry["data_offsets"]
            return np.frombuffer(raw[8 + size + a : 8 + size + b], kinds[entry["dtype"]]).reshape(entry["shape"]).astype(np.float32)
    raise ValueError(f"{path} holds no matrix")


def _static(model: StaticModel) -> Callable[[list[str | None]], np.ndarray]:
    from tokenizers import Tokenizer

    folder = Path(model.folder)
    tokenizer = Tokenizer.from_file(str(folder / "tokenizer.json"))
    table = np.load(folder / "vectors.npy") if (folder / "vectors.npy").exists() else _read_safetensors(folder / "model.safetensors")

    def embed(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), table.shape[1]), dtype=np.float32)
        for row, e in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            if ids := e.ids[: model.max_tokens]:
                mean = table[ids].mean(axis=0)
                out[row] = mean / (np.linalg.norm(mean) or 1)
        return out

    return embed


_models: dict[Backend, Callable[[list[str | None]], np.ndarray]] = {}


def embed(texts: list[str | None], backend: Backend) -> np.ndarray:
    """Vectors of texts, on the driver or in a Python worker."""
    if isinstance(backend, Hashing):
        return hashed(texts, backend.dimensions, backend.digest)
    if backend not in _models:
        _models[backend] = _static(backend)
    return _models[backend](texts)


def embedding(text: Column, backend: Backend) -> Column:
    """Vector of a text column, an Arrow batch at a time."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        m = embed(texts.to_pylist(), backend)
        ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).reshape(-1)))

    return vectors(text)


def _sum_of_products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is null, empty or zero, or if their lengths differ."""
    norms = F.sqrt(_sum_of_products(a, a)) * F.sqrt(_sum_of_products(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.coalesce(F.when(usable, _sum_of_products(a, b) / norms), F.lit(0.0))


def to_bytes(vector: np.ndarray | list[float]) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    if len(data) % 4:
        raise ValueError("not a whole number of 4-byte floats")
    return np.frombuffer(data, dtype="<f4")
