"""Command line: ``python -m seqrec.cli preprocess|train|similar|prepare-next …``."""

from __future__ import annotations

import argparse
import json

from seqrec import jobs
from seqrec.plans.session import session
from seqrec.sources.readers import parse_id_list


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqrec")
    sub = top.add_subparsers(dest="job", required=True)
    p = sub.add_parser("preprocess")
    for name in ("interactions", "books", "authors", "genres", "works", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--trim", type=int, default=200)
    p.add_argument("--keep", choices=["first", "last"], default="first")
    p.add_argument("--min-count", type=int, default=10)
    p = sub.add_parser("train")
    p.add_argument("--sequences", required=True)
    p.add_argument("--model-dir", required=True)
    for name, kind, value in (("window", int, 5), ("dim", int, 100), ("negatives", int, 5), ("rate", float, 0.025), ("epochs", int, 10), ("max-pairs", int, 50_000), ("updates-per-epoch", int, 1)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p = sub.add_parser("similar")
    p.add_argument("--model-dir", required=True)
    p.add_argument("--book-ids", default="")
    p.add_argument("--title", action="append", default=[])
    p.add_argument("--random-samples", type=int, default=0)
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--metadata-path")
    p = sub.add_parser("prepare-next")
    p.add_argument("--reviews", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--min-history", type=int, default=5)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session("seqrec")
    if a.job == "preprocess":
        sources = {k: getattr(a, k) for k in ("interactions", "books", "authors", "genres", "works")}
        print(json.dumps(jobs.preprocess(spark, sources, a.out, a.trim, a.keep, a.min_count)))
    elif a.job == "train":
        jobs.train(spark, a.sequences, a.model_dir, window=a.window, dim=a.dim, negatives=a.negatives, rate=a.rate, epochs=a.epochs, max_pairs=a.max_pairs, updates_per_epoch=a.updates_per_epoch)
    elif a.job == "similar":
        jobs.similar(spark, a.model_dir, parse_id_list(a.book_ids), a.title, a.random_samples, a.top_k, a.metadata_path).orderBy("query_id", "rank").show(1000, False)
    else:
        jobs.prepare_next_item(spark, a.reviews, a.out, a.min_history)


if __name__ == "__main__":
    main()
