"""Suffix-array deduplication: passages of ``LEAST`` words or more that stand in more than one document.

Every window of LEAST words is owned by the least hash of the GRAM-word grams in it, a function of its words alone; windows in
a row with one owner are a *run*. Equal windows have equal owners, so runs whose owner occurs in a single document cannot
repeat, and all others are sharded by owner: each shard sees every copy of its windows. Within a shard, runs with the same
words stand for each other, and the words of the distinct ones are put one after another and their suffix and common-prefix
arrays built by external induced sorting (see ``suffix``). Neighbouring suffixes that share LEAST words or more are the copies
of one window. The copy with the smallest id and place is kept, all others go. Documents are never gathered in one place, and
what a shard reads is bounded by the number of shards, which grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import common, textvec
from tarn.llm.packing import gather, squeeze
from tarn.llm.suffix import Scratch, suffix_array

#: Words of a passage; words of a gram; words that a shard holds on average; bytes of an array that stay in memory.
LEAST, GRAM, SHARD_WORDS, MEMORY = 50, 10, 1_500_000, 64 << 20

_RUNS = "key long, cls long, doc_id long, th long, start int, n int"
_NAMES = ["key", "cls", "doc_id", "th", "start", "n"]
_ONE = np.uint64(0x9FB21C651E98DF25)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of rows with id and text, in lower case; th tells rows of one id apart."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.lower("text").alias("text"))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def owners(hashed: np.ndarray, rows: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows: row, first word within the row, number of words, owner."""
    empty = np.zeros(0, np.int64)
    if len(hashed) < least:
        return empty, empty, empty, np.zeros(0, np.uint64)
    g = hashed[: len(hashed) - gram + 1].copy()
    for j in range(1, gram):
        g *= textvec._STEP
        g += hashed[j : j + len(g)]
    owner = _sliding_min(textvec.mix(g), least - gram + 1)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(owner)]
    inside = np.arange(len(owner)) + least <= rows[1:][row]
    edge = np.ones(len(owner), dtype=bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(edge & inside)
    stop = np.flatnonzero(inside & np.append(edge[1:] | ~inside[1:], True)) + 1
    return row[first], first - rows[row[first]], stop - first + least - 1, owner[first]


def _runs(least: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            t = textvec.tokens(batch.column("text"))
            row, start, n, owner = owners(t.hash, t.rows, least, gram)
            if not len(row):
                continue
            # content of a run: a polynomial hash from prefix sums, so that overlapping runs cost no more
            power = np.full(len(t.hash), textvec._STEP, dtype=np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textvec.mix(t.hash ^ _ONE) * power, dtype=np.uint64)))
            a = t.rows[row] + start
            # the step is odd, so it has an inverse: divide by the power of the run's first place
            inverse = np.full(len(t.hash), np.uint64(pow(int(textvec._STEP), -1, 1 << 64)), dtype=np.uint64)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            content = textvec.mix((prefix[a + n] - prefix[a]) * inverse[a] ^ n.astype(np.uint64))
            of = pa.array(row)
            yield pa.record_batch(
                [pa.array(owner.view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=_NAMES,
            )

    return emit


_WORDS = "shard int, head binary, words binary"


def _contents(shards: int):
    """Words of the runs that stand for their class, packed for each shard; head: owner, content, lengths and ids by column."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            t = textvec.tokens(batch.column("text"))
            codes = (t.hash >> np.uint64(32)).astype("<u4")
            runs = batch.column("runs")
            flat = runs.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(runs)))
            column = {name: np.asarray(flat.field(name)).astype(np.int64) for name in ("key", "cls", "start", "n", "last")}
            doc = np.asarray(batch.column("doc_id"))[row]
            start, n = t.rows[row] + column["start"], column["n"]
            shard = (textvec.mix(column["key"].view(np.uint64) + _ONE) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            out: dict[str, list] = {"shard": [], "head": [], "words": []}
            for k in np.flatnonzero(np.diff(cuts)):
                of = by[cuts[k] : cuts[k + 1]]
                head = np.stack([column["key"][of], column["cls"][of], n[of], doc[of], column["last"][of], column["start"][of]])
                out["shard"].append(int(k))
                out["head"].append(squeeze()[0].compress(common.blob(head)))
                out["words"].append(squeeze()[0].compress(gather(codes, start[of], n[of]).tobytes()))
            if out["shard"]:
                yield pa.record_batch([pa.array(out["shard"], pa.int32()), pa.array(out["head"], pa.binary()), pa.array(out["words"], pa.binary())], names=["shard", "head", "words"])

    return emit


_RANGES = "key long, cls long, a int, b int, kept boolean"


def repeats_in(words: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, least: int, scratch: Scratch) -> tuple[np.ndarray, ...]:
    """Ranges of windows, as (run, first, last + 1, kept), that stand in two documents or more.

    ``words`` holds the runs one after another; a run's first copy is in document ``low`` at ``start``, its copies' largest
    id is ``high``. ``kept``: the run's first copy is the one that stays.
    """
    ids = (np.unique(words, return_inverse=True)[1] + 1).astype(np.int32)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = scratch.array(int(sizes.sum() + len(sizes)), np.int32)
    gaps = np.zeros(len(text), dtype=bool)
    gaps[begin + sizes] = True
    text[gaps] = 0
    text[~gaps] = ids
    del ids
    sa, lcp = suffix_array(text, scratch)
    run_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    window = np.arange(len(text)) - begin[run_of] + least <= sizes[run_of]
    # windows in the order of suffixes; between two of them the shared length is the least on the way
    at = np.flatnonzero(window[sa])
    place = sa[at]
    shared = np.zeros(len(at), dtype=np.int64)
    if len(at) > 1:
        shared[1:] = np.minimum.reduceat(lcp, at[:-1] + 1)
        shared[-1] = lcp[at[-2] + 1 : at[-1] + 1].min()
    del sa, lcp, window, at
    group = np.cumsum(shared < least) - 1
    run = run_of[place]
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    many = (np.minimum.reduceat(low[run], heads) != np.maximum.reduceat(high[run], heads)) if len(heads) else np.zeros(0, bool)
    position = start[run] + place - begin[run]
    order = np.lexsort((position, low[run], group))  # groups stay where they are: the first of each is the copy that stays
    kept = np.zeros(len(place), dtype=bool)
    kept[order[heads]] = True
    flagged = np.zeros(len(text), dtype=np.int8)
    flagged[place[many[group]]] = 1
    flagged[place[many[group] & kept]] = 2
    edge = np.flatnonzero(np.diff(flagged, prepend=0, append=0))  # runs end in a gap, so no range crosses one
    first, last = edge[:-1], edge[1:]
    some = flagged[first] > 0 if len(first) else np.zeros(0, bool)
    first, last = first[some], last[some]
    owner = run_of[first]
    return owner, first - begin[owner], last - begin[owner], flagged[first] == 2


def _sorted(least: int, folder: str | None, memory: int):
    def one(heads: list[np.ndarray], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        scratch = Scratch(folder, memory)
        try:
            table, flat = np.concatenate(heads, axis=1), np.concatenate(words)
            first = np.sort(np.unique(table[:2], axis=1, return_index=True)[1])  # repeated rows bring a class more than once
            at = np.cumsum(table[2]) - table[2]
            flat, (key, cls, n, low, high, start) = gather(flat, at[first], table[2][first]), table[:, first]
            run, a, b, kept = repeats_in(flat, n, low, high, start, least, scratch)
            if len(run):
                yield pa.record_batch([pa.array(key[run]), pa.array(cls[run]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(kept)], names=["key", "cls", "a", "b", "kept"])
        finally:
            scratch.close()
            common.trim()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, heads, words = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard and heads:
                    yield from one(heads, words)
                    heads, words = [], []
                shard = row["shard"]
                heads.append(np.frombuffer(squeeze()[1].decompress(row["head"]), dtype="<i8").reshape(6, -1))
                words.append(np.frombuffer(squeeze()[1].decompress(row["words"]), dtype="<u4"))
        if heads:
            yield from one(heads, words)

    return emit


def scratch_folder(spark: SparkSession) -> str | None:
    """Where arrays beyond memory go: the shared folder if it is mounted as a path, else nowhere (they stay in memory)."""
    where = common.scratch_path(spark, "suffixes")
    return where.removeprefix("file://").removeprefix("file:") if where.startswith(("file:", "/")) else None


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard_words: int = SHARD_WORDS, memory: int = MEMORY) -> DataFrame:
    """(doc_id, th, start, stop, first): stretches of words, start to stop - 1, of which every window repeats elsewhere.

    ``first`` marks stretches that stay (the copy of smallest id and place); others are to go. th is the hash of the text.

    Words are compared in lower case. Windows that repeat within one document only do not count; so repeated rows of one id
    do not make its text a repeat, and texts of rows of one id with different texts count as one document. Rows without id
    or text, and texts below ``least`` words, have no rows, nor has an empty table. Other columns are ignored.
    """
    if not 0 < gram <= least:
        raise ValueError("gram must be from 1 to least")
    spark = docs.sparkSession
    texts = texts_of(docs)
    runs = common.staged(texts.mapInArrow(common.trimmed(_runs(least, gram)), _RUNS), "runs")
    # first copy and largest id of each class, then of each owner: added up before the shuffle, however hot an owner is
    alike = runs.groupBy("key", "cls").agg(F.min(F.struct("doc_id", "start", "th")).alias("lead"), F.max("doc_id").alias("last"), F.first("n").alias("n"))
    alike = common.staged(alike.select("key", "cls", "lead.*", "last", "n"), "classes")
    shared = alike.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("last").alias("hi")).where("lo <> hi").select("key")
    cand = common.staged(common.join_small(alike, common.staged(shared, "owners"), "key", "left_semi"), "candidates")
    total = cand.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    leads = cand.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "cls", "start", "n", "last")).alias("runs"))
    full = texts.join(leads.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "text", "runs")
    words = full.mapInArrow(common.trimmed(_contents(shards)), _WORDS).repartition(shards, "shard").sortWithinPartitions("shard")
    ranges = common.staged(words.mapInArrow(common.trimmed(_sorted(least, scratch_folder(spark), memory)), _RANGES), "ranges")
    lead = cand.select("key", "cls", F.struct("doc_id", "start", "th").alias("lead"))
    ranges = common.staged(common.join_small(lead, ranges, ["key", "cls"]), "placed")
    found = common.join_small(runs, ranges, ["key", "cls"]).select(
        "doc_id",
        "th",
        (F.col("start") + F.col("a")).alias("start"),
        (F.col("start") + F.col("b") + (least - 1)).alias("stop"),
        (F.col("kept") & (F.struct("doc_id", "start", "th") == F.col("lead"))).alias("first"),  # repeated rows are one copy
    )
    line = Window.partitionBy("doc_id", "th", "first").orderBy("start", "stop")
    before = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "th", "first", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc_id", "th", "start", "stop", "first")


def cut_words(text: str, starts: list[int], stops: list[int]) -> str:
    """``text`` without the words from each start to its stop - 1, and without what stands between those and the next word."""
    raw = text.encode()
    t = textvec.tokens(pa.array([text], pa.string()))
    begin = np.append(t.start, len(raw))
    parts, at = [], 0
    for a, b in sorted(zip(starts, stops)):
        parts.append(raw[at : max(at, begin[a])])
        at = max(at, int(begin[b]))
    return (b"".join(parts) + raw[at:]).decode()


def _has_word(text: str) -> bool:
    return bool(textvec.tokens(pa.array([text], pa.string())).counts[0])


def remove(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without all but the first copy of each repeated passage (see ``spans``); n_chars, if there, is counted anew.

    A document of which no word stays goes. Rows without id, null and empty texts, and rows without repeats stay as they are;
    other columns pass through.
    """
    found = spans(docs, **parameters).where("NOT first")
    cuts = common.staged(found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts")), "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            fields = {f.name: row.field(i) for i, f in enumerate(row.type)}
            texts = [cut_words(t, [c["start"] for c in c_], [c["stop"] for c in c_]) for t, c_ in zip(fields["text"].to_pylist(), batch.column("cuts").to_pylist())]
            left = pa.array([_has_word(t) for t in texts], pa.bool_())
            fields["text"] = pa.array(texts, row.type.field("text").type)
            if "n_chars" in fields:
                fields["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(row.type.field("n_chars").type)
            yield pa.record_batch([pa.StructArray.from_arrays(list(fields.values()), fields=list(row.type))], ["row"]).filter(left)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    size = cuts.agg(F.count("*"), F.sum(F.size("_cuts"))).first()
    small = (size[0] + (size[1] or 0)) * 2 <= common.BROADCAST_ROWS
    cuts = cuts.select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_hash"), F.col("_cuts").alias("cuts"))
    both = rows.join(F.broadcast(cuts) if small else cuts, (F.col("id") == F.col("cut_id")) & (F.col("hash") == F.col("cut_hash")), "left")
    # only rows with something to cut go through Python
    changed = both.where("cuts IS NOT NULL").select("row", "cuts").mapInArrow(common.trimmed(cut), rows.select("row").schema)
    whole = both.where("cuts IS NULL").select("row").unionAll(changed)
    return whole.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
