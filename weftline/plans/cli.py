"""Command line: python -m weftline.plans.cli search | export | evaluate | people | compare."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.order import numbered
from weftline.operators import people, social
from weftline.operators.documents import build_documents
from weftline.operators.suggest import TEST_QUERIES
from weftline.plans.engine import SearchEngine
from weftline.sources import io, sinks


def product_documents(spark: SparkSession, path: str) -> DataFrame:
    """Search documents of a product file, numbered in the order of its rows."""
    rows = io.read_products(spark, path).withColumn("_row", F.monotonically_increasing_id())
    return build_documents(numbered(rows, "_row"))


def post_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Posts of several files, with the file's name as the account and the row's place in it."""
    out = None
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
        one = io.read_posts(spark, path).select(F.lit(name).alias("account"), "views", "likes", "created_at", "like_rate", F.monotonically_increasing_id().alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline")
    commands = top.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="expanded search over a product file")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--no-synonyms", action="store_true")
    search.add_argument("--no-feedback", action="store_true")
    search.add_argument("--use-embeddings", action="store_true")
    search.add_argument("--embedding-backend", default="bert")
    export = commands.add_parser("export", help="write documents and index as JSON")
    export.add_argument("--output-dir", required=True)
    evaluate = commands.add_parser("evaluate", help="precision, recall and latency of the fixed queries")
    evaluate.add_argument("--top-k", type=int, default=10)
    evaluate.add_argument("--labels", help="a JSON file with lists of document places by query")
    for p in (search, export, evaluate):
        p.add_argument("--data-path", required=True)
    score = commands.add_parser("people", help="features, models and reports of a mail file")
    score.add_argument("--data-path", required=True)
    score.add_argument("--output-dir", required=True)
    score.add_argument("--min-emails", type=int, default=5)
    compare = commands.add_parser("compare", help="summaries of accounts, a post file each")
    compare.add_argument("paths", nargs="+")
    compare.add_argument("--output-dir", required=True)
    compare.add_argument("--top-n", type=int, default=5)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What the command prints."""
    table = lambda df, n=1000: df._show_string(n, 40)
    if args.command == "compare":
        posts = post_tables(spark, args.paths)
        made = sinks.write_comparison(posts, "row", args.output_dir, max(1, args.top_n))
        return "\n".join([table(social.summarize(posts)), *(f"{k}: {v}" for k, v in made.items())])
    if args.command == "people":
        mails = io.read_mails(spark, args.data_path)
        scored = people.run(mails, max(1, args.min_emails))
        cover = people.coverage(people.mail_features(mails.join(scored.people.select("from_name"), "from_name", "left_semi")))
        made = sinks.write_people(scored, cover, args.output_dir)
        best = scored.cv[scored.model_name]
        head = [f"Model  : {scored.model_name}", f"CV R2  : {best['r2']:.4f}", f"CV RMSE: {best['rmse']:.4f}", table(people.decisions(scored.people))]
        return "\n".join([*head, *(f"{k}: {v}" for k, v in made.items())])
    engine = SearchEngine(spark, product_documents(spark, args.data_path))
    if args.command == "export":
        return "\n".join(f"Written: {p}" for p in sinks.write_index_file(engine.index, engine.docs, args.output_dir))
    if args.command == "evaluate":
        labels = json.loads("\n".join(r[0] for r in spark.read.text(args.labels).collect())) if args.labels else None
        rows, summary = engine.evaluate(TEST_QUERIES, labels, max(1, args.top_k))
        return f"{table(rows)}\n{table(summary)}"
    found = engine.search_once(args.query, top_k=max(1, args.top_k), use_synonyms=not args.no_synonyms, use_feedback=not args.no_feedback, use_embeddings=args.use_embeddings, backend=args.embedding_backend)
    return json.dumps([r.asDict() for r in found.drop("content").collect()], indent=2)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(run(SparkSession.builder.appName("weftline").getOrCreate(), args))


if __name__ == "__main__":
    main()
