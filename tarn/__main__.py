"""Command line: build, build-bundle, update-cache, export-index, export-bundle, inspect, benchmark, search."""

from __future__ import annotations

import argparse
import json
import sys

from tarn.functions.embedding import Hashing, StaticModel
from tarn.operators.cache import BuildCache, open_cache
from tarn.operators.chunking import Chunking
from tarn.operators.index import BuildOptions, IndexFolder, build
from tarn.plans.relevance import evaluate, summary
from tarn.plans.search import open_index
from tarn.session import local_session
from tarn.sources.bundle import export_bundle, read_queries
from tarn.sources.directory import read_directory, update_from_directory


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tarn", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for argument in arguments:
            sub.add_argument(argument)
        sub.add_argument("--text", action="store_true", help="plain lines in place of JSON")
        return sub

    for name, arguments in (("build", ("input", "index")), ("build-bundle", ("input", "bundle")), ("update-cache", ("input", "cache"))):
        sub = command(name, *arguments)
        sub.add_argument("--root", default="root")
        sub.add_argument("--dimensions", type=int, default=256)
        sub.add_argument("--model", help="folder of a static embedding model")
        sub.add_argument("--target-tokens", type=int, default=512)
        sub.add_argument("--overlap-tokens", type=int, default=64)
        if name == "update-cache":
            sub.add_argument("--git-diff", action="store_true")
            sub.add_argument("--git-base")
    command("export-index", "cache", "index")
    command("export-bundle", "index", "bundle")
    command("inspect", "index")
    command("benchmark", "index", "queries")
    sub = command("search", "index", "query")
    sub.add_argument("--top-k", type=int)
    sub.add_argument("--mode")
    sub.add_argument("--min-score", type=float)
    sub.add_argument("--path-prefix")
    sub.add_argument("--metadata", action="append", default=[], metavar="KEY=JSON")
    sub.add_argument("--reranker")
    sub.add_argument("--candidate-pool-size", type=int)
    sub.add_argument("--numeric-multiplier")
    sub.add_argument("--mode-profile")
    return parser


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _options(args: argparse.Namespace) -> BuildOptions:
    backend = StaticModel(args.model) if args.model else Hashing(args.dimensions)
    return BuildOptions(args.root, backend, Chunking(args.target_tokens, args.overlap_tokens))


def run(args: argparse.Namespace, spark) -> object:
    match args.command:
        case "build":
            return build(spark, read_directory(spark, args.input), args.index, _options(args))
        case "build-bundle":
            build(spark, read_directory(spark, args.input), f"{args.bundle}/.index", _options(args))
            return export_bundle(spark, f"{args.bundle}/.index", args.bundle)
        case "update-cache":
            return update_from_directory(BuildCache(spark, args.cache, _options(args)), args.input, args.git_diff, args.git_base)
        case "export-index":
            return open_cache(spark, args.cache).export_index(args.index)
        case "export-bundle":
            return export_bundle(spark, args.index, args.bundle)
        case "inspect":
            manifest = IndexFolder(spark, args.index).manifest()
            return open_cache(spark, args.index).info() if "config_fingerprint" in manifest else open_index(spark, args.index).info()
        case "benchmark":
            found = evaluate(open_index(spark, args.index), read_queries(spark, args.queries))
            return summary(found) | {"queries": [r.asDict() for r in found.orderBy("name").collect()]}
        case _:
            reranker = {"kind": args.reranker} | ({"candidate_pool_size": args.candidate_pool_size} if args.candidate_pool_size else {}) if args.reranker else None
            metadata = {k: _value(v) for k, _, v in (m.partition("=") for m in args.metadata)}
            return open_index(spark, args.index, args.mode_profile).search(
                args.query, top_k=args.top_k, mode=args.mode, min_score=args.min_score, relative_path_prefix=args.path_prefix, metadata=metadata, reranker=reranker, numeric_multiplier=args.numeric_multiplier
            )


def emit(result: object, text: bool) -> str:
    if not text:
        return json.dumps(result, ensure_ascii=False)
    rows = result if isinstance(result, list) else [result]
    return "\n".join(f"{r['rank']}. {r['relative_path']} ({r['score']:.6f})\n   {r['best_match']['excerpt'][:120]!r}" if "rank" in r else "\n".join(f"{k}: {v}" for k, v in r.items()) for r in rows)


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    try:
        print(emit(run(args, local_session()), args.text))
    except (ValueError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
