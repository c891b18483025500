"""URL filter by a path-template tree.

URLs of a host form a tree of path segments. Numbers are wildcards at once; level by level, a segment becomes a wildcard of
its kind if it is taken by less than SHARE of the URLs at its node and has fewer than TESTED labels, too few to be told from the
others. However large the node, a segment with enough labels stays. What remains is merged host by host: branches of a node whose labelled outcomes do not differ
significantly become one. A template's purity is its share of good labels, smoothed towards its parent's, and a host's
towards the corpus's; templates below the least purity are rejected with all their pages. Only counts of templates are gathered by host, never URLs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

#: Labels with which a segment is a literal whatever its share: the least for which the test behind ``alike`` holds.
TESTED = 5
#: Share of a node's URLs that a literal with fewer labels needs; z below which branches are alike; weight of the parent's
#: purity in labels; purity that a template needs.
SHARE, ALIKE, SMOOTHING, LEAST = 1 / 16, 1.96, 8.0, 0.4
#: Distinct paths, counted, that tasks finish host by host once no more of them reach a level; above it, levels are joins.
FEW = 50_000
#: Words of a host's name by which its pages are labelled bad.
BAD_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")
_KIND = r"\.(html?|php|aspx?|jsp|xml|json|pdf|txt|md)$"


def host_of(url: Column) -> Column:
    """Host in lower case without user, port, final dot and leading www; null where a URL has none."""
    rest = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.|\.$", "")
    return F.when(F.trim(url).rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//") & (host != ""), host)


def segments(url: Column) -> Column:
    """Path segments with numbers as ``{n}``, and last the names of the query's parameters in order, if any."""
    rest = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*|#.*$", "")
    parts = F.filter(F.split(F.regexp_extract(rest, r"^([^?]*)", 1), "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.regexp_replace(F.lower(s), r"[0-9]+", "{n}"))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "[&;]"), lambda s: s != ""), lambda s: F.regexp_replace(F.lower(s), "=.*$", ""))))
    return F.when(F.size(names) > 0, F.concat(parts, F.array(F.concat(F.lit("?"), F.array_join(names, "&"))))).otherwise(parts)


def _wildcard(segment: Column) -> Column:
    """What stands for a segment that is no literal: ``{*}``, with the kind of file, or ``?*`` for a query."""
    kind = F.regexp_extract(segment, _KIND, 0)
    return F.when(segment.startswith("?"), F.lit("?*")).when(segment.rlike(r"^\{n\}" + _KIND[:-1] + "?$"), segment).otherwise(F.concat(F.lit("{*}"), kind))


def generalised(paths: DataFrame, share: float = SHARE) -> DataFrame:
    """``paths`` (host, path array, n, good, bad, ...) with ``template``: the path after rare segments that labels say too little
    of have become wildcards.

    A level at a time, for paths that reach it; when a count shows that few are left, however deep, they are finished below
    their nodes by the same rule.
    """
    now, done, level = paths.withColumn("template", F.array().cast("array<string>")).withColumn("wild", F.transform("path", _wildcard)), None, 0
    while True:
        ended = now.where(F.size("path") <= level)
        done = ended if done is None else done.unionByName(ended)
        now = now.where(F.size("path") > level)
        left = now.count()
        if not left:
            break
        now = now.withColumn("node", F.array_join("template", "/"))
        if left <= FEW:
            done = done.unionByName(now.groupBy("host", "node").applyInArrow(_finish(level, share), now.schema).drop("node"))
            break
        now = now.withColumn("segment", F.get("path", F.lit(level)))
        taken = now.groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), F.sum(F.col("good") + F.col("bad")).alias("labels"))
        total = taken.groupBy("host", "node").agg(F.sum("n").alias("total"))
        literal = taken.join(total, ["host", "node"]).where((F.col("n") >= F.lit(share) * F.col("total")) | (F.col("labels") >= TESTED))
        literal = common.staged(literal.select("host", "node", "segment", F.lit(True).alias("literal")), "literals")
        now = common.join_small(now, literal, ["host", "node", "segment"], "left")
        chosen = F.when(F.col("literal"), F.col("segment")).otherwise(F.get("wild", F.lit(level)))
        now = common.staged(now.withColumn("template", F.concat("template", F.array(chosen))).drop("literal", "segment", "node"), "level")
        level += 1
    return done.drop("wild")


def _finish(level: int, share: float):
    """The rest of the templates of paths below one node."""

    def finish(below: pa.Table) -> pa.Table:
        path, wild, template = (below[c].to_pylist() for c in ("path", "wild", "template"))
        n, labels = below["n"].to_pylist(), [g + b for g, b in zip(below["good"].to_pylist(), below["bad"].to_pylist())]
        stack = [(list(range(len(path))), level)]
        while stack:
            inside, depth = stack.pop()
            inside = [i for i in inside if len(path[i]) > depth]
            counts: dict[str, list[int]] = {}
            for i in inside:
                of = counts.setdefault(path[i][depth], [0, 0])
                of[0], of[1] = of[0] + n[i], of[1] + labels[i]
            total = sum(c[0] for c in counts.values())
            branches: dict[str, list[int]] = {}
            for i in inside:
                x = path[i][depth]
                name = x if counts[x][0] >= share * total or counts[x][1] >= TESTED else wild[i][depth]
                template[i].append(name)
                branches.setdefault(name, []).append(i)
            stack += [(of, depth + 1) for of in branches.values()]
        at = below.schema.get_field_index("template")
        return below.set_column(at, below.schema.field(at), pa.array(template, below.schema.field(at).type))

    return finish


def alike(a: tuple[int, int], b: tuple[int, int], z: float = ALIKE) -> bool:
    """Whether two pairs of (good, bad) counts do not differ significantly; they do not where either has no labels."""
    n, m = sum(a), sum(b)
    if not n or not m:
        return True
    pooled = (a[0] + b[0]) / (n + m)
    spread = math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return spread == 0 or abs(a[0] / n - b[0] / m) < z * spread


def merge(rows: list[tuple[list[str], int, int]], prior: float) -> Iterator[tuple[int, str, float]]:
    """(index, final template, purity) of each row (template, good, bad): alike branches of a node become one, from the root.

    The root is smoothed towards ``prior`` and each branch towards its node; a node's only branch is as pure as the node.
    """

    def purity(good: int, bad: int, of_node: float) -> float:
        return (good + SMOOTHING * of_node) / (good + bad + SMOOTHING)

    start = purity(sum(r[1] for r in rows), sum(r[2] for r in rows), prior)
    stack = [(list(range(len(rows))), 0, "", start)]
    while stack:
        inside, depth, prefix, own = stack.pop()
        branches: dict[str | None, list[int]] = {}
        for i in inside:
            branches.setdefault(rows[i][0][depth] if len(rows[i][0]) > depth else None, []).append(i)
        counted = [(name, sum(rows[i][1] for i in of), sum(rows[i][2] for i in of), of) for name, of in branches.items()]
        counted.sort(key=lambda c: (purity(c[1], c[2], own), c[0] or ""))
        groups: list[tuple[list[str], int, int, list[int]]] = []
        for name, good, bad, of in counted:
            if name is None:
                pure = own if len(counted) == 1 else purity(good, bad, own)
                yield from ((i, prefix or "/", pure) for i in of)
            elif groups and alike(groups[-1][1:3], (good, bad)):
                names, g, b, before = groups.pop()
                groups.append(([*names, name], g + good, b + bad, before + of))
            else:
                groups.append(([name], good, bad, of))
        alone = len(groups) == 1 and None not in branches
        for names, good, bad, of in groups:
            label = names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
            stack.append((of, depth + 1, f"{prefix}/{label}", own if alone else purity(good, bad, own)))


_MERGED = "host string, key string, template string, n_pages long, n_good long, n_bad long, purity double"


def _of_host(prior: float):
    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["key"])
        name, pure = {}, {}
        for i, template, purity in merge([(r["template"], r["good"], r["bad"]) for r in rows], prior):
            name[i], pure[template] = template, purity
        sums: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            total = sums.setdefault(name[i], [0, 0, 0])
            for k, column in enumerate(("n", "good", "bad")):
                total[k] += r[column]
        out = []
        for i, r in enumerate(rows):
            n, good, bad = sums[name[i]]
            out.append((r["host"], r["key"], name[i], n, good, bad, pure[name[i]]))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["host", "key", "template", "n_pages", "n_good", "n_bad", "purity"])

    return one


def judge(pages: DataFrame, labels: DataFrame, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """(page_id, host, template, n_pages, n_good, n_bad, purity, keep) for each row of ``pages`` (page_id, url).

    ``labels`` (page_id, good) may have repeated rows (the worst counts), nulls and unknown ids (they change nothing). A page
    whose URL is null, empty or names no host has a null template and purity and is kept. Without labels all are kept: the
    corpus's purity is then 1. Repeated rows count, and are judged, each; rows without id are never labelled. An empty
    table gives no rows; other columns are ignored.
    """
    known = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min("good").alias("good"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url")).withColumn("host", host_of(F.col("url")))
    rows = rows.withColumn("path", F.when(F.col("host").isNotNull(), segments(F.col("url")))).drop("url").join(known, "page_id", "left")
    rows = common.staged(rows.withColumn("raw", F.array_join("path", "/")), "pages")
    counts = rows.where("host IS NOT NULL").groupBy("host", "raw").agg(
        F.first("path").alias("path"), F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    paths = common.staged(counts, "paths")
    total = paths.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    prior = total.g / (total.g + total.b) if total.g or total.b else 1.0
    shaped = generalised(paths, share).withColumn("key", F.array_join("template", "/"))
    templates = shaped.groupBy("host", "key").agg(F.first("template").alias("template"), *[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    merged = common.staged(templates.groupBy("host").applyInArrow(_of_host(prior), _MERGED), "templates")
    named = common.staged(shaped.select("host", "raw", "key").join(merged, ["host", "key"]).drop("key"), "named")
    hint = F.broadcast(named) if named.count() <= common.BROADCAST_ROWS // 8 else named
    found = rows.select("page_id", "host", "raw").join(hint, ["host", "raw"], "left")
    return found.select("page_id", "host", "template", "n_pages", "n_good", "n_bad", F.round("purity", 9).alias("purity"), F.coalesce(F.col("purity") >= F.lit(least), F.lit(True)).alias("keep"))


def page_labels(pages: DataFrame, labels: DataFrame, bad_words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """(page_id, good): pages of hosts named with a bad word are bad; others are labelled as the document whose number their
    path gives (good: of good quality and not toxic). Pages of which nothing is known have no row."""
    worst = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("number")).agg((F.min("quality") * (1 - F.max(F.coalesce("toxic", F.lit(0)))) > 0).alias("good"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1) AS long)").alias("number"))
    named = F.arrays_overlap(F.split("host", "[.\\-]"), F.array(*[F.lit(w) for w in bad_words]))
    rows = rows.withColumn("bad", F.coalesce(named, F.lit(False))).join(worst, "number", "left")
    return rows.select("page_id", (F.col("good") & ~F.col("bad")).alias("known"), "bad").select("page_id", F.when(F.col("bad"), F.lit(False)).otherwise(F.col("known")).alias("good")).where("good IS NOT NULL")
