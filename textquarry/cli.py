"""Command line: registered queries over a folder of tables, articles parsed into tables, articles as texts to read."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.relations import remaining, seeded_sample


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="textquarry")
    actions = parser.add_subparsers(dest="action", required=True)
    query = actions.add_parser("query", help="run a registered query and write its rows")
    query.add_argument("name")
    query.add_argument("--tables", required=True, help="folder of parquet tables")
    names = actions.add_parser("queries", help="list the registered queries")
    names.add_argument("--with-sql", action="store_true", help="only those that have SQL")
    articles = actions.add_parser("articles", help="parse XML articles into documents, sections and blocks")
    view = actions.add_parser("view", help="articles as texts to read")
    for action in (articles, view):
        action.add_argument("--nxml-dir", required=True)
        action.add_argument("--ids", nargs="*", help="these articles only")
        action.add_argument("--limit", type=int, help="this many articles, drawn by a seeded hash")
        action.add_argument("--seed", type=int, default=42)
        action.add_argument("--test", action="store_true", help="three articles only")
    view.add_argument("--max-chars", type=int, help="characters of each section")
    for action in (query, articles, view):
        action.add_argument("--output", required=True)
        action.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
        action.add_argument("--resume", action="store_true", help="leave an output that is there as it is; articles: add those that it lacks")
    return parser.parse_args(argv)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def _write(rows: DataFrame, path: str, form: str, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    (writer.option("header", True).option("escape", '"') if form == "csv" else writer).format(form).save(path)


def chosen(files: DataFrame, args: argparse.Namespace) -> DataFrame:
    """The asked articles: by id, then a sample of a seeded hash."""
    files = files.filter(F.col("doc_id").isin(*args.ids, *[f"PMC{x}" for x in args.ids])) if args.ids else files
    n = 3 if args.test else args.limit
    return files if n is None else seeded_sample(files, "doc_id", n, args.seed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    if args.action == "queries":
        from .plans import queries

        print("\n".join(sorted(queries.ORACLES if args.with_sql else queries.QUERIES)))
        return
    spark = spark or SparkSession.builder.appName("textquarry").getOrCreate()
    if args.action == "query":
        from .plans import queries

        if args.name not in queries.QUERIES:
            raise SystemExit(f"no query {args.name}; see: textquarry queries")
        if not (args.resume and _exists(spark, args.output)):
            _write(queries.QUERIES[args.name](spark, args.tables), args.output, args.format)
        return
    from .plans import viewers
    from .sources import articles as source

    files = chosen(source.read_files(spark, args.nxml_dir), args)
    first = f"{args.output}/{'documents' if args.action == 'articles' else 'views'}"
    going_on = args.resume and _exists(spark, first)
    if going_on:
        files = remaining(files, spark.read.options(header=True, multiLine=args.format == "csv", escape='"').format(args.format).load(first), "doc_id")
    parsed = source.trees(files)
    if args.action == "view":
        sections = source.sections(parsed).withColumnRenamed("order", "section_index")
        texts = source.blocks(parsed).groupBy("doc_id", F.col("parent_section_id").alias("section_id")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n").alias("text")
        )
        rows = viewers.articles(source.documents(parsed), sections.join(texts, ["doc_id", "section_id"], "left"), args.max_chars)
        _write(rows, first, args.format, "append" if going_on else "overwrite")
        return
    for name, rows in (("documents", source.documents(parsed)), ("sections", source.sections(parsed)), ("blocks", source.blocks(parsed)), ("failures", source.failures(parsed))):
        rows = rows.select(*[F.to_json(f.name).alias(f.name) if args.format == "csv" and f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in rows.schema])
        _write(rows, f"{args.output}/{name}", args.format, "append" if going_on else "overwrite")


if __name__ == "__main__":
    main()
