"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are read in blocks of a few megabytes. A block's pre-tokens are exploded into distinct words and the positions where
each stands; words go, packed by the hash of the word, to the partition that encodes each distinct word of the corpus once,
and come back to their block as token ids, where they are put in the order of the positions. Positions travel as one
compressed sequence per block and cross the network once; words cross it once for each block that has them.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common, textvec
from tarn.llm.packing import BLOCKS_A_TASK, WIRE, WIRE_ARROW, gather, pack, squeeze, unpack, wire_row

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block.
BLOCK = 8_000_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _explode(buckets: int):
    """Texts to blocks: one row (key = block) with the ids, word counts, positions and checks of its texts, and for each
    bucket that has words one row (key = -1 - bucket) with the block's distinct words of that bucket."""
    split = regex.compile(PATTERN).findall

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * BLOCKS_A_TASK
        for part in common.slices(batches, "text", BLOCK):
            local, counts, checks = [], [], []
            seen: dict[str, int] = {}
            for piece in common.slices(iter([part]), "text", 1_000_000):
                texts = piece.column("text").to_pylist()
                pieces = [split(x) if x else [] for x in texts]
                counts.append(np.fromiter((len(p) for p in pieces), np.int64, len(pieces)))
                checks.append(np.fromiter((_digest((x or "").encode()) for x in texts), np.int64, len(texts)))
                encoded = pa.array([w for p in pieces for w in p], pa.string()).dictionary_encode()
                new = np.fromiter((seen.setdefault(w, len(seen)) for w in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
                local.append(new[np.asarray(encoded.indices, dtype=np.int64)])
            local = np.concatenate(local)
            words = pa.array(list(seen), pa.string())
            # frequent words get small numbers, so that positions compress well
            order = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            words = words.take(pa.array(order))
            bucket = (textvec.hash_rows(words) % np.uint64(buckets)).astype(np.int64)
            missing = part.column("text").is_null()
            rows = [
                wire_row(
                    block, block, -1,
                    common.blob(np.asarray(part.column("row_id"))) + common.blob(np.asarray(missing.cast(pa.int64()))),
                    pack(np.concatenate(counts)),
                    pack(place[local]),
                    pack(bucket),
                    common.blob(np.concatenate(checks)),
                )
            ]
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                raw, off = common.flat_binary(words.take(pa.array(by[cuts[k] : cuts[k + 1]])))
                rows.append(wire_row(-1 - int(k), block, int(k), squeeze()[0].compress(raw.tobytes()), pack(np.diff(off))))
            yield pa.RecordBatch.from_pylist(rows, WIRE_ARROW)
            block += 1

    return emit


def _encode(ranks):
    """Word rows to token rows for the block they came from; each distinct word of the partition is encoded once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("tarn", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})  # a word is one piece
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:  # rows come sorted by bucket, so only one bucket's words need be known at a time
            for i in np.flatnonzero(np.asarray(batch.column("key")) < 0):
                if (now := batch.column("key")[int(i)].as_py()) != bucket:
                    bucket, known = now, {}
                raw = squeeze()[1].decompress(batch.column("a")[int(i)].as_py())
                end = np.cumsum(unpack(batch.column("b")[int(i)].as_py()), dtype=np.int64).tolist()
                flat, sizes, start = array.array("I"), [], 0
                for stop in end:
                    word = raw[start:stop]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = coder.encode_ordinary(word.decode())
                    flat.extend(ids)
                    sizes.append(len(ids))
                    start = stop
                block = batch.column("block")[int(i)].as_py()
                row = wire_row(block, block, batch.column("bucket")[int(i)].as_py(), pack(np.array(sizes)), pack(np.frombuffer(flat, dtype="<u4")))
                yield pa.RecordBatch.from_pylist([row], WIRE_ARROW)

    return emit


_OUT = pa.schema([("row_id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("exact", pa.bool_())])


def _reassembler(ranks):
    """Blocks and the ids of their words to texts' tokens; ``exact``: decoding them gives the bytes that the text had."""

    def reassemble(blocks: pa.Table, words: pa.Table) -> pa.Table:
        common.lean()
        return _reassemble(blocks, words, ranks.value)

    return reassemble


def _exact(lists: pa.ListArray, checks: np.ndarray, of_token: pa.Array) -> pa.Array:
    """Whether each row's tokens, joined with the token-byte table, have the digest of the text; some rows at a time."""
    out, ends = [], np.asarray(lists.offsets)
    cuts = [0, *(np.flatnonzero(np.diff(ends[:-1] // 200_000)) + 1).tolist(), len(lists)] if len(lists) else []
    for a, b in zip(cuts, cuts[1:]):
        raw, off = _joined(lists.slice(a, b - a), of_token)
        out += [_digest(raw[x:y].tobytes()) for x, y in zip(off, off[1:])]
    return pa.array(np.array(out, np.int64) == checks, pa.bool_())


def _reassemble(blocks: pa.Table, words: pa.Table, ranks: dict[bytes, int]) -> pa.Table:
    out, of_token = [], None
    for row in blocks.to_pylist():
        if row["key"] < 0:
            continue
        ids = np.frombuffer(row["a"], dtype="<i8").reshape(2, -1)
        counts, local, bucket = unpack(row["b"]).astype(np.int64), unpack(row["c"]).astype(np.int64), unpack(row["d"])
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(int(bucket.max()) + 2)) if len(bucket) else np.zeros(1, np.int64)
        size, flat, start, at = np.zeros(len(bucket), np.int64), [], np.zeros(len(bucket), np.int64), 0
        for k, a, b in zip(words["bucket"].to_pylist(), words["a"].to_pylist(), words["b"].to_pylist()):
            of, n = by[cuts[k] : cuts[k + 1]], unpack(a).astype(np.int64)
            size[of] = n
            start[of] = at + np.cumsum(n) - n
            flat.append(unpack(b))
            at += len(flat[-1])
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        tokens = gather(flat, start[local], size[local]).astype(np.int32)
        upto = np.concatenate(([0], np.cumsum(size[local])))[np.concatenate(([0], np.cumsum(counts)))]
        lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(tokens), mask=pa.array(ids[1] == 1))
        of_token = _token_bytes(ranks) if of_token is None else of_token
        out.append(pa.table([pa.array(ids[0]), lists, _exact(lists, np.frombuffer(row["e"], dtype="<i8"), of_token)], schema=_OUT))
    return pa.concat_tables(out) if out else _OUT.empty_table()


def encode(docs: DataFrame, id_column: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for each row of ``docs``; ``exact`` says that decoding gave back the text's bytes.

    Special tokens' strings are ordinary text. A null text has null tokens and n_tokens 0, an empty text no tokens. Repeated
    rows and rows without id are encoded like any other; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))  # a fixed vocabulary, whatever the corpus
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing = -(1 << 63)
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(missing)).alias("row_id"), "text")
    wire = texts.mapInArrow(common.trimmed(_explode(4 * partitions)), WIRE).repartition(partitions, "key")
    coded = wire.sortWithinPartitions("key").mapInArrow(common.trimmed(_encode(ranks)), WIRE).repartition(partitions, "key")
    found = wire.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(_reassembler(ranks), "row_id long, tokens array<int>, exact boolean")
    return found.select(
        F.when(F.col("row_id") != missing, F.col("row_id")).alias("doc_id"),
        "tokens",
        F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"),
        "exact",
    )


def _token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table: bytes of token i at place i, null where there is none."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def _joined(tokens: pa.Array, of_token: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Join token ids with the token-byte table and put the bytes of each row together: bytes, row offsets."""
    tokens = tokens.cast(pa.list_(pa.int32()))
    off = np.asarray(tokens.offsets, dtype=np.int64)
    flat = tokens.values.slice(off[0], off[-1] - off[0])
    raw, ends = common.flat_binary(of_token.take(flat))
    return raw, ends[off - off[0]]


def decode(df: DataFrame, column: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with a ``text`` column: the bytes of each row's tokens in order. Null tokens give null, no tokens an empty text.

    Bytes that are no valid UTF-8 (possible where tokens were cut) become U+FFFD; ids outside the vocabulary, and nulls
    within a list, add nothing.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.arrow_udf("string")
    def text(tokens: pa.Array) -> pa.Array:
        common.lean()
        of_token = _token_bytes(ranks.value)
        flat = tokens.cast(pa.list_(pa.int32()))
        inside = pa.compute.and_(pa.compute.greater_equal(flat.values, 0), pa.compute.less(flat.values, len(of_token)))
        flat = pa.ListArray.from_arrays(flat.offsets, pa.compute.if_else(inside, flat.values, pa.scalar(None, pa.int32())))
        raw, off = _joined(flat, of_token)
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off, off[1:])]
        return pa.array([None if null else row for row, null in zip(rows, tokens.is_null().to_pylist())], pa.string())

    return df.withColumn("text", text(F.col(column)))
