"""Identities and fingerprints. Ids of documents and chunks are BLAKE3, so they are the same in every build of a source;
fingerprints, which never leave this engine, are SHA-256 by built-in functions."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tarn.functions import blake3


@F.arrow_udf(StringType())
def blake3_hex(text: pa.Array) -> pa.Array:
    """Hex BLAKE3 of a string's UTF-8 bytes; null for null."""
    values = text.to_pylist()
    found = iter(blake3.hexdigests([v.encode() for v in values if v is not None]))
    return pa.array([None if v is None else next(found) for v in values], pa.string())


@F.arrow_udf(LongType())
def _leading_long(text: pa.Array) -> pa.Array:
    values = [v.encode() for v in text.fill_null("").to_pylist()]
    head = blake3.digests(values)[:, :8].copy().view(">i8").reshape(-1)
    return pa.array(head.astype("int64") & 0x7FFF_FFFF_FFFF_FFFF, pa.int64())


def document_id(root: Column, relative_path: Column, given: Column | None = None) -> Column:
    """The id that was given, else the hash of root and path."""
    made = blake3_hex(F.concat(root, F.lit(":"), relative_path))
    return made if given is None else F.coalesce(given, made)


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    """A non-negative 64-bit number from document id and ordinal."""
    return _leading_long(F.concat(doc_id, F.lit(":"), ordinal.cast("string")))


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def document_fingerprint(relative_path: Column, canonical_url: Column, title: Column, summary: Column, content: Column, metadata_json: Column) -> Column:
    """Changes whenever something changes that the index holds of a document; its id and source path do not count."""
    parts = [relative_path, canonical_url, title, summary, content, metadata_json]
    fields = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *fields), 256)


def config_fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
