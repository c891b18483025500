"""N-gram Jaccard join by chosen paths.

Each text is the set of its word n-grams. Documents with the same set are told by two hashes, and the smallest id stands for
all of them. Sets are embedded as K minhash values, and a run grows a tree of paths: in a node each set picks every
(coordinate, value) with probability ``growth / (threshold * K)`` by a hash that the node seeds, so two sets at the threshold
are expected to share ``growth`` of their picks. A pick is a child node. Since picks depend on the set and the node alone, a
task finds all its sets' paths without seeing other sets; one shuffle brings each first-level node's sets together, where
the node is split by the further picks until a bucket is small. Buckets that are still large then are split by picks among
the last four bits of the minhash values, for as long as that saves work; a node of more sets than a task should hold is not
kept, but its sets go on to its children by another shuffle. All pairs of a small bucket are compared by size and by those
bits. Runs repeat until a pair at the threshold is missed, by paths or by bits, with no more than ``1 - recall``.

Of survivors only what connects them leaves a task: at most an edge for each set of a bucket, however many of its pairs
survive. All pairs of a connected group are then compared, by size and bits and exactly on their full n-gram sets, once each,
in squares of bounded size; a square gives the links of each of its sets as a sum, and again only what connects them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common, graph, textvec
from tarn.llm.graph import components
from tarn.llm.packing import gather

N, THRESHOLD, RECALL = 3, 0.5, 0.99
#: Minhash coordinates; levels of a path; picks that sets at the threshold share in expectation; bucket size not split further.
COORDINATES, LEVELS, GROWTH, SMALL = 64, 3, 1.2, 24
#: Picks of last bits that sets at the threshold share in expectation; sets of a node that a task holds, beyond it the node is dealt out.
DEEP, HOT = 2.0, 50_000
#: Documents of a group, and n-grams, on one side of a square that a task compares at a time; larger groups are cut into several.
SIDE, GRAMS = 2000, 1_000_000
#: Edges that a task holds before it keeps only what connects their ends; rows of its results that it gives out at a time.
EDGES, ROWS = 500_000, 100_000
#: Rows of a table of several columns that may be broadcast: some 100 bytes each in every executor.
WIDE_ROWS = 500_000

_KEYS = textvec.mix(np.arange(1, 4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_NIBBLES = np.uint64(0x1111_1111_1111_1111)


def _least_bits(threshold: float) -> float:
    """Coordinates whose last four bits must agree for a pair to be compared exactly: 3.5 sigma below the expectation."""
    share = threshold + (1 - threshold) / 16
    return COORDINATES * share - 3.5 * math.sqrt(COORDINATES * share * (1 - share))


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold is a candidate with probability ``recall``.

    Counted over the number of minhash values on which such a pair agrees: it must share a path down to a bucket that is no
    longer split, in one run at least, and its last bits must agree often enough.
    """
    n, least = COORDINATES, _least_bits(threshold)
    binomial = lambda m, k, p: math.comb(m, k) * p**k * (1 - p) ** (m - k)
    odds = []
    for k in range(n + 1):
        bits = sum(binomial(n - k, j, 1 / 16) for j in range(n - k + 1) if k + j >= least)
        agree = (k + (n - k) / 16) / n
        alive = 1.0
        for _ in range(50):
            alive = 1 - math.exp(-DEEP * agree / (threshold + (1 - threshold) / 16) * alive)
        for _ in range(levels):
            alive = 1 - math.exp(-GROWTH * k / (n * threshold) * alive)
        odds.append((binomial(n, k, threshold) * bits, alive))
    for runs in range(1, len(_KEYS) - 300):
        if sum(p * (1 - (1 - alive) ** runs) for p, alive in odds) >= recall:
            return runs
    raise ValueError("this recall cannot be reached")


def minhashes(sets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """COORDINATES values of 32 bits for each set (none may be empty)."""
    out = np.empty((len(rows) - 1, COORDINATES), dtype=np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(((sets * _KEYS[i]) >> np.uint64(32)).astype(np.uint32), rows[:-1])
    return out


def sketches(low: np.ndarray) -> np.ndarray:
    """The last four bits (of a hash) of each minhash value, packed into words."""
    out = np.zeros((len(low), COORDINATES // 16), dtype=np.uint64)
    for i in range(COORDINATES):
        out[:, i // 16] |= (textvec.mix(low[:, i].astype(np.uint64) + _KEYS[100 + i]) & np.uint64(15)) << np.uint64(4 * (i % 16))
    return out


def picks(tokens: np.ndarray, node: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For each node and its set's tokens (a row): index of the node and key of each child that is picked."""
    drawn = textvec.mix(tokens ^ node[:, None])
    at, coordinate = np.nonzero(drawn < limit)
    return at, textvec.mix(drawn[at, coordinate] + textvec._STEP)


def _paths(n: int, threshold: float, runs: int, levels: int):
    limit = np.uint64(min(GROWTH / (threshold * COORDINATES), 1.0) * (2**64 - 1025))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets, rows = textvec.ngram_sets(textvec.tokens(batch.column("text")), n)
            size = np.diff(rows)
            ids = np.asarray(batch.column("doc_id"))
            some = np.flatnonzero(size)
            if not len(some):
                continue
            size, ids = size[some], ids[some]
            low = minhashes(sets, np.append(rows[some], len(sets)))
            whole = np.add.reduceat(textvec.mix(sets ^ _KEYS[70]), rows[some]) ^ textvec.mix(size.astype(np.uint64))
            sketch = sketches(low)
            tokens = textvec.mix(low.astype(np.uint64) ^ _KEYS[None, 200 : 200 + COORDINATES])
            for run in range(runs):
                root = np.full(len(some), _KEYS[300 + run], dtype=np.uint64)
                doc, first = picks(tokens, root, limit)
                path, node, deeper = np.arange(len(doc)), first, []
                for _ in range(1, levels):
                    at, child = picks(tokens[doc[path]], node, limit)
                    deeper.append((path[at], child, node[at]))
                    path, node = path[at], child
                # one row per first-level node; its set's further picks are packed as (level, parent, child)
                if deeper:
                    owner = np.concatenate([d[0] for d in deeper])
                    packed = np.stack([np.concatenate([d[2] for d in deeper]), np.concatenate([d[1] for d in deeper])], axis=1)
                    order = np.argsort(owner, kind="stable")
                    more = common.binary_rows(packed[order].reshape(-1), 2 * np.bincount(owner, minlength=len(first)))
                else:
                    more = pa.array([b""] * len(first), pa.binary())
                if len(first):
                    yield pa.record_batch(
                        [pa.array(first.view(np.int64)), pa.array(ids[doc]), pa.array(whole[doc].view(np.int64)), pa.array(size[doc].astype(np.int64)), common.binary_rows(sketch[doc].reshape(-1), np.full(len(doc), COORDINATES // 16)), more],
                        ["node", "doc_id", "whole", "size", "sketch", "more"],
                    )

    return emit


_PATH_SCHEMA = "node long, doc_id long, whole long, size long, sketch binary, more binary"


def _may_reach(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i ascending, of sets (size, sketch) that may reach the threshold by size and by minhash values whose last four
    bits agree; some rows i at a time."""
    least, n = _least_bits(threshold), len(other[0])
    step = max(1, 1_000_000 // max(1, n))
    for a in range(0, len(one[0]), step):
        size, sketch = one[0][a : a + step, None], one[1][a : a + step]
        same = np.full((len(size), n), COORDINATES, dtype=np.uint8)
        for mine, its in zip(sketch.T, other[1].T):
            x = mine[:, None] ^ its[None, :]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            x &= _NIBBLES
            same -= np.bitwise_count(x)
        near = np.minimum(size, other[0][None, :]) >= threshold * np.maximum(size, other[0][None, :]) - 1e-9
        i, j = np.nonzero((same >= least) & near)
        yield i + a, j


class _Forest:
    """Groups of 0 to n-1 that edges connect; ``root`` has the least of each one's group."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """An edge (root, i) for each i that is not a root."""
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.root[at], at


def _connecting(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), a < b, fewer than there are ids, that connect the same ids as all the given ones."""
    ids, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    forest = _Forest(len(ids))
    forest.join(*np.split(place, 2))
    x, y = forest.stars()
    return ids[x], ids[y]


def _compare(ids: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the ids of a bucket as its pairs do that may reach the threshold."""
    forest = _Forest(len(ids))
    for i, j in _may_reach((size, sketch), (size, sketch), threshold):
        forest.join(i, j)
        if not forest.root.any():  # all are one group
            break
    x, y = forest.stars()
    return ids[x], ids[y]


_SPLIT_SCHEMA = "a long, b long, " + _PATH_SCHEMA
_TOKENS = textvec.mix(np.arange(16 * COORDINATES, dtype=np.uint64) + _KEYS[500])
_SHIFTS = np.arange(0, 64, 4, dtype=np.uint64)


def _links(more: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(parent, child) of all rows' further picks, and the row of each."""
    raw, off = common.flat_binary(more)
    return raw.view("<u8").reshape(-1, 2), np.repeat(np.arange(len(more)), np.diff(off) // 16)


def _children(node: np.uint64, links: np.ndarray, owner: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Children of a node that its sets pick, the set that picks each, and whether the picks are of last bits, for which
    there are no further picks left."""
    own = links[:, 0] == node
    if own.any():
        return links[own, 1], owner[own], False
    drawn = textvec.mix(_TOKENS ^ node)
    share = threshold + (1 - threshold) / 16
    chosen = np.flatnonzero(drawn < np.uint64(min(DEEP / (share * COORDINATES), 1.0) * (2**64 - 1025)))
    child, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for token in chosen.tolist():
        coordinate, bits = divmod(token, 16)
        at = np.flatnonzero((sketch[:, coordinate // 16] >> _SHIFTS[coordinate % 16]) & np.uint64(15) == bits)
        child.append(np.full(len(at), textvec.mix(drawn[token] + textvec._STEP)))
        who.append(at)
    return np.concatenate(child), np.concatenate(who), True


def _saves(child: np.ndarray, n: int) -> bool:
    """Whether comparing a node's children is less than half the work of comparing its n sets."""
    return int((np.unique(child, return_counts=True)[1].astype(np.int64) ** 2).sum()) * 2 < n * n


def _split(threshold: float):
    def node_edges(node, ids, size, sketch, more) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        links, owner = _links(more)
        stack = [(np.arange(len(ids)), node)]
        while stack:
            inside, node = stack.pop()
            if len(inside) < 2:
                continue
            if len(inside) <= SMALL:
                yield _compare(ids[inside], size[inside], sketch[inside], threshold)
                continue
            child, who, bits = _children(node, links, owner, sketch[inside], threshold)
            if bits:
                if not _saves(child, len(inside)):
                    yield _compare(ids[inside], size[inside], sketch[inside], threshold)
                    continue
                who = inside[who]
            order = np.argsort(child, kind="stable")
            child, who = child[order], who[order]
            cuts = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1]))) if len(child) else []
            for a, b in zip(cuts, [*cuts[1:], len(child)]):
                if b - a > 1:
                    stack.append((np.unique(who[a:b]), child[a]))

    def packed(column: pa.Array) -> np.ndarray:
        return common.flat_binary(column)[0].view("<u8").reshape(len(column), -1)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of one node as rows of its children."""
        child, who, _ = _children(np.asarray(batch.column("node"))[:1].view(np.uint64)[0], *_links(batch.column("more")), packed(batch.column("sketch")), threshold)
        rows = batch.take(pa.array(who))
        nothing = pa.nulls(len(who), pa.int64())
        return pa.record_batch([nothing, nothing, pa.array(child.view(np.int64)), *[rows.column(i) for i in range(1, rows.num_columns)]], ["a", "b", *rows.schema.names])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(h.num_rows for h in held):  # nothing comes before a node that is dealt out
            return
        t = pa.Table.from_batches(held).combine_chunks()
        node, ids = t["node"].to_numpy(), t["doc_id"].to_numpy()
        whole, size = t["whole"].to_numpy(), t["size"].to_numpy()
        one = lambda name: t[name].chunk(0) if t[name].num_chunks == 1 else t[name].combine_chunks()
        sketch, more = packed(one("sketch")), one("more")
        # rows come sorted by node, set and id: the first of each set stands for all with the same set
        lead = np.ones(len(node), dtype=bool)
        lead[1:] = (node[1:] != node[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(lead)
        cuts = np.flatnonzero(np.concatenate(([True], node[at][1:] != node[at][:-1])))
        ends = np.append(cuts[1:], len(at))
        a_out, b_out, held_edges, limit = [], [], 0, EDGES
        for a, b in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1]):
            rows = at[a:b]
            if b - a <= SMALL:
                found = [_compare(ids[rows], size[rows], sketch[rows], threshold)]
            else:
                found = node_edges(node[rows[0] : rows[0] + 1].view(np.uint64)[0], ids[rows], size[rows], sketch[rows], more.take(pa.array(rows)))
            for x, y in found:
                a_out.append(x)
                b_out.append(y)
                held_edges += len(x)
                if held_edges > limit:
                    x, y = _connecting(a_out, b_out)
                    a_out, b_out, held_edges = [x], [y], len(x)
                    limit = max(EDGES, 2 * held_edges)
        if held_edges:
            x, y = _connecting(a_out, b_out)
            rest = [pa.nulls(len(x), t.schema.field(name).type) for name in t.schema.names]
            yield pa.record_batch([pa.array(x), pa.array(y), *rest], ["a", "b", *t.schema.names])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tail, last = [], 0, None  # rows of whole nodes, and of the last one; number of those, and its key
        passing = kept = None  # the node that is dealt out; the node that is held however large, as dealing it out saves nothing
        for batch in batches:
            node = np.asarray(batch.column("node"))
            if passing is not None and len(node):
                k = len(node) if (node == passing).all() else int(np.argmin(node == passing))
                if k:
                    yield dealt(batch.slice(0, k))
                batch, node = batch.slice(k), node[k:]
            if not len(node):
                continue
            passing = None
            change = np.flatnonzero(node[1:] != node[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut or node[0] != last:
                held.append(batch.slice(0, cut)) if cut else None
                if sum(h.num_rows for h in held) > 20_000:
                    yield from flush(held)
                    held = []
                tail = 0
            held.append(batch.slice(cut))
            tail, last = tail + batch.num_rows - cut, node[-1]
            if tail > HOT and last != kept:
                t = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)[0]
                yield from flush([t.slice(0, t.num_rows - tail)])
                of_node = t.slice(t.num_rows - tail)
                child, _, bits = _children(node[-1:].view(np.uint64)[0], *_links(of_node.column("more")), packed(of_node.column("sketch")), threshold)
                if bits and not _saves(child, tail):
                    held, kept = [of_node], last
                else:
                    yield dealt(of_node)
                    held, tail, passing, last = [], 0, last, None
        yield from flush(held)

    return emit


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of rows with id and text, in lower case; th tells texts of one id apart."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("th"), "text")


def candidates(texts: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """(a, b), a < b, from ``texts`` (doc_id, text): edges that connect the same ids as all pairs do that share a path in some
    run and may reach the threshold; fewer than there are picks, while such pairs may be as many as all pairs of a large group."""
    rows, found = texts.mapInArrow(common.trimmed(_paths(n, threshold, runs_needed(recall, threshold, levels), levels)), _PATH_SCHEMA), None
    while True:
        split = rows.repartition("node").sortWithinPartitions("node", "whole", "doc_id").mapInArrow(common.trimmed(_split(threshold)), _SPLIT_SCHEMA)
        split = common.staged(split, "split")
        pairs = split.where("a IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.unionAll(pairs)
        rows = split.where("a IS NULL").drop("a", "b")
        if rows.isEmpty():
            return found.distinct()


def named(texts: DataFrame, n: int = N) -> DataFrame:
    """(id, th, one, two, size): two hashes and the size of each text's set of n-grams; texts without words have no row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets, rows = textvec.ngram_sets(textvec.tokens(batch.column("text")), n)
            some = np.flatnonzero(np.diff(rows))
            if len(some):
                one = np.add.reduceat(textvec.mix(sets ^ _KEYS[70]), rows[some])
                two = np.add.reduceat(textvec.mix(sets ^ _KEYS[71]), rows[some])
                of = pa.array(some)
                yield pa.record_batch([batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(rows)[some])], ["id", "th", "one", "two", "size"])

    return texts.mapInArrow(common.trimmed(name), "id long, th long, one long, two long, size long")


def _alike(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, jaccard) for each of ``rows`` that reaches the threshold exactly with some j of ``columns``; if those are the same
    as the rows, j > i."""
    size, n, flat = np.array([len(x) for x in sets], dtype=np.int64), len(sets), np.concatenate(sets)
    of = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    cut, mark = np.concatenate(([0], np.cumsum(size))), np.zeros(int(of.max()) + 1, dtype=np.uint8)
    start, triangle = cut[:-1], np.array_equal(rows, columns)
    if n > SMALL:
        parts = [(a, min(a + 500, n)) for a in range(0, n, 500)]
        sketch = np.concatenate([sketches(minhashes(flat[cut[a] : cut[b]], cut[a : b + 1] - cut[a])) for a, b in parts])
        chunks = _may_reach((size[rows], sketch[rows]), (size[columns], sketch[columns]), threshold)
    else:
        i, j = np.meshgrid(np.arange(len(rows)), np.arange(len(columns)), indexing="ij")
        chunks = iter([(i.reshape(-1), j.reshape(-1))])
    for i, j in chunks:
        if triangle:
            i, j = i[i < j], j[i < j]
        cuts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else []
        for a, b in zip(cuts, [*cuts[1:], len(i)]):
            own, others = rows[i[a]], columns[j[a:b]]
            mine = of[start[own] : start[own] + size[own]]
            mark[mine] = 1
            # a row's partners some at a time, so that their n-grams take little room
            piece = np.cumsum(size[others]) // 1_000_000
            for k in range(int(piece[-1]) + 1):
                some = others[piece == k]
                if not len(some):
                    continue
                shared = np.add.reduceat(mark[gather(of, start[some], size[some])], np.cumsum(size[some]) - size[some], dtype=np.int32)
                value = shared / (size[own] + size[some] - shared)
                ok = value >= threshold
                if ok.any():
                    yield own, some[ok], value[ok]
            mark[mine] = 0


def _verify(n: int, threshold: float, whole: bool):
    """Squares, sorted by key, to their pairs (a, b, jaccard) if ``whole``, else to (a, b, far): each set a that has links in the
    square, the least set b of those that links connect it with there, and how many members the sets have that it links with."""

    def square(row: int, column: int, ids: np.ndarray, side: np.ndarray, count: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        once = np.unique(ids, return_index=True)[1]  # repeated rows
        ids, side, count, sets = ids[once], side[once], count[once], [sets[k] for k in once]
        rows, columns = np.flatnonzero(side == row), np.flatnonzero(side == column)
        if not len(rows) or not len(columns):
            return
        forest, far, out, n_out = _Forest(len(ids)), np.zeros(len(ids), dtype=np.int64), [], 0

        def given() -> Iterator[pa.RecordBatch]:
            if not out:
                return
            x, y = np.repeat([o[0] for o in out], [len(o[1]) for o in out]), np.concatenate([o[1] for o in out])
            if whole:
                yield pa.record_batch([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(np.concatenate([o[2] for o in out]))], ["a", "b", "jaccard"])
            else:
                forest.join(x, y)
            out.clear()

        for i, js, value in _alike(sets, rows, columns, threshold):
            far[i] += count[js].sum()
            far[js] += count[i]
            out.append((i, js, value))
            n_out += len(js)
            if n_out > ROWS:
                yield from given()
                n_out = 0
        yield from given()
        at = np.flatnonzero(far)
        if not whole and len(at):
            yield pa.record_batch([pa.array(ids[at]), pa.array(ids[forest.root[at]]), pa.array(far[at])], ["a", "b", "far"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for part in common.slices(batches, "text"):
            values, cuts = textvec.ngram_sets(textvec.tokens(part.column("text")), n)
            keys = np.stack([np.asarray(part.column(name)).astype(np.int64) for name in ("component", "row", "column")], axis=1)
            ids, side, count = (np.asarray(part.column(name)).astype(np.int64) for name in ("doc_id", "side", "n"))
            firsts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for a, b in zip(firsts, [*firsts[1:], len(keys)]):
                now = tuple(keys[a].tolist())
                if now != key and held:
                    yield from square(key[1], key[2], *(np.concatenate([h[k] for h in held]) for k in range(3)), [x for h in held for x in h[3]])
                    held = []
                key = now
                held.append((ids[a:b], side[a:b], count[a:b], [values[cuts[k] : cuts[k + 1]].copy() for k in range(a, b)]))
        if held:
            yield from square(key[1], key[2], *(np.concatenate([h[k] for h in held]) for k in range(3)), [x for h in held for x in h[3]])

    return emit


def _linked(docs: DataFrame, n: int, threshold: float, recall: float, levels: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) and what ``_verify`` finds of nodes."""
    texts = texts_of(docs)
    member, nodes = graph.contents(common.staged(named(texts, n), "names"), "th", "size", limit=WIDE_ROWS)
    leads = nodes.select(F.col("id").alias("doc_id"), "th", "node")
    texts = common.join_small(texts, leads, ["doc_id", "th"], limit=WIDE_ROWS).select(F.col("node").alias("doc_id"), "text")  # one text of each set; more only where rows repeat
    edges = common.staged(candidates(texts, n, threshold, recall, levels), "candidates")
    label = components(edges).withColumnRenamed("id", "node")
    label = label.join(nodes.select("node", "size"), "node").join(member.groupBy("node").agg(F.count("*").alias("n")), "node")
    label = common.staged(label, "labels")
    sides = F.ceil(F.greatest(F.count("*") / SIDE, F.sum("size") / GRAMS)).cast("int")
    place = label.join(label.groupBy("component").agg(sides.alias("sides")), "component")
    place = place.select(F.col("node").alias("doc_id"), "component", "n", "sides", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int").alias("side"))
    key = ["component", "row", "column"]
    placed = common.join_small(texts, common.staged(place, "places"), "doc_id", limit=WIDE_ROWS)
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    squares = placed.select("component", F.least("side", "with").alias("row"), F.greatest("side", "with").alias("column"), "doc_id", "side", "n", "text")
    found = squares.repartition(*key).sortWithinPartitions(*key).mapInArrow(common.trimmed(_verify(n, threshold, whole)), "a long, b long, jaccard double" if whole else "a long, b long, far long")
    return member, common.staged(found, "pairs")


def near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) and pairs (a, b, jaccard), a < b: a node stands for a set of n-grams, its members are the documents
    that have it, and two nodes are a pair if the exact Jaccard similarity of their sets reaches the threshold."""
    return _linked(docs, n, threshold, recall, levels, True)


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, levels: int) -> DataFrame:
    """(id, class_id, links) of each document with words; no table has a row for each pair."""
    member, found = _linked(docs, n, threshold, recall, levels, False)
    return graph.classes_of(member, found.where("a <> b").select("a", "b"), found.groupBy(F.col("a").alias("node")).agg(F.sum("far").alias("far")))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """(doc_id, class_id, links) of each document: a link is another document whose set of n-grams reaches the threshold,
    copies included; class_id is the smallest id that links connect with the document.

    Texts are compared in lower case by words; one of 1 to n-1 words has one shingle, its words. Null, empty and wordless
    texts have no links and are a class of their own; rows without doc_id are left out. Repeated rows count once; an id with
    several different texts has the links of each of them. An empty table gives no rows; other columns are ignored.
    """
    found = _classes(docs, n, threshold, recall, levels).withColumnRenamed("id", "doc_id")
    alone = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("class_id", F.col("doc_id")).withColumn("links", F.lit(0).cast("long"))
    every = found.unionByName(alone)
    return every.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """``docs`` without all but the smallest id of each class (see ``classes``). Rows without id stay."""
    gone = common.staged(_classes(docs, n, threshold, recall, levels).where("id <> class_id").select(F.col("id").alias("doc_id")), "gone")
    return common.join_small(docs, gone, "doc_id", "left_anti")
