"""Command line: ``python -m millrace.cli COMMAND``; see ``--help`` of each command."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str, store: bool = False) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=text)
        for x in arguments:
            out.add_argument(x)
        if store:
            out.add_argument("--store", default="millrace-store", help="folder of the stored tables")
        return out

    command("version", "print the version")
    command("list", "names of the registered queries")
    command("query", "run a registered query over a folder of tables", "name", "folder").add_argument("--out", help="write Parquet here; without it the first rows are shown")
    command("pages", "Markdown pages of the workbooks and PDFs at a path, in chunks", "path").add_argument("--out")
    command("init", "make the stored tables", store=True)
    command("list-schemas", "record schemas by name").add_argument("--user", help="folder of modules with more schemas")
    for name, text, arguments in (
        ("extract", "extract records from the files at a path", ("path", "schema")), ("resume", "extract what a job still lacks", ("job_id", "schema")), ("retry", "ask again for pending dead letters", ("schema",)),
    ):
        own = command(name, text, *arguments, store=True)
        own.add_argument("--url", default="http://localhost:11434", help="endpoint of the backend")
        own.add_argument("--model", default="")
        own.add_argument("--user", help="folder of modules with more schemas")
        own.add_argument("--retries", type=int, default=2)
        if name == "extract":
            own.add_argument("--pages")
            own.add_argument("--force", action="store_true", help="do not reuse a completed job")
        if name == "retry":
            own.add_argument("--job")
    command("status", "jobs as they stand, or one in detail", store=True).add_argument("--job")
    export = command("export", "a job's records", "job_id", "out", store=True)
    export.add_argument("--format", choices=("jsonl", "csv"), default="jsonl")
    clean = command("clean", "remove a job and all that hangs on it", "job_id", store=True)
    clean.add_argument("--yes", action="store_true")
    scored = command("eval", "score job results (JSON lines) against a manifest", "manifest", "results")
    scored.add_argument("--out", help="write the outcomes as JSON here")
    bench = command("bench", "wall time of registered queries", "folder")
    bench.add_argument("--queries", default="token_estimate,chunk_documents,anchor_score")
    bench.add_argument("--out", help="folder for the JSON and CSV files")
    return parser


def main(args: list[str] | None = None) -> int:
    given = _parser().parse_args(args)
    if given.command == "version":
        print(__version__)
        return 0
    if given.command == "list-schemas":
        from . import schemas

        found, problems = schemas.discover(given.user)
        for name, fields in found.items():
            print(f"{name}: {', '.join(f.name for f in fields)}")
        for name, problem in problems.items():
            print(f"{name}: {problem}", file=sys.stderr)
        return 0
    from .plans.queries import QUERIES

    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    try:
        return _with_spark(spark, given, QUERIES)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


def _with_spark(spark, given: argparse.Namespace, queries: dict) -> int:
    if given.command == "query":
        if given.name not in queries:
            raise ValueError(f"no query named {given.name}")
        df = queries[given.name](spark, given.folder)
        df.write.parquet(given.out) if given.out else df.show()
        return 0
    if given.command == "pages":
        from .operators.chunking import chunk_pages
        from .sources import documents

        found = documents.files(spark, given.path)
        excel = documents.workbook_pages(documents.workbook_rows(found.where("NOT lower(path) LIKE '%.pdf'")))
        pdf = documents.pdf_pages(found.where("lower(path) LIKE '%.pdf'")).select("path", "page_index", "text")
        df = chunk_pages(excel.unionByName(pdf).withColumnRenamed("path", "job_id"))
        df.write.parquet(given.out) if given.out else df.show()
        return 0
    if given.command == "eval":
        from . import suite

        verdicts, differences = suite.score_file(spark, given.manifest, given.results)
        rows = suite.report(verdicts, differences)
        if given.out:
            Path(given.out).write_text(json.dumps(rows, ensure_ascii=False, indent=2))
        print(json.dumps({k: v for k, v in rows.items() if k != "outcomes"}))
        return 0 if rows["overall_ok"] else 1
    if given.command == "bench":
        from . import benches

        rows = benches.measure(spark, {n: queries[n] for n in given.queries.split(",")}, given.folder)
        if given.out:
            benches.write(rows, given.out)
        print(json.dumps(rows))
        return 0
    return _with_store(spark, given)


def _with_store(spark, given: argparse.Namespace) -> int:
    from . import jobrun, schemas
    from .operators.extraction import OllamaBackend
    from .sources import records
    from .store import Store

    store = Store(spark, given.store)
    if given.command == "init":
        store.init()
        return 0
    if given.command == "status":
        jobs = store.jobs()
        if given.job:
            from .operators.reports import job_detail

            one = jobs.where(jobs.job_id == given.job)
            job_detail(one, store.runs(), store.stages()).show(truncate=False)
            return 0
        jobs.select("job_id", "path", "status", "total_chunks", "created_at").show(50, truncate=False)
        return 0
    if given.command == "export":
        rows = jobrun.records(store, given.job_id)
        if given.format == "jsonl":
            rows.select("record").write.text(given.out)
        else:
            keys = sorted({k for r in rows.selectExpr("explode(json_object_keys(record)) AS k").distinct().collect() for k in r})
            cells = rows.selectExpr("from_json(record, 'map<string,string>') AS m")
            records.write_csv(cells.select(*[cells.m[k].alias(k) for k in keys]), given.out)
        return 0
    if given.command == "clean":
        if not given.yes:
            raise ValueError("say --yes to remove a job")
        store.delete(spark.createDataFrame([(given.job_id,)], "job_id string"))
        return 0
    found, _ = schemas.discover(given.user)
    if given.schema not in found:
        raise ValueError(f"no schema named {given.schema}; there are {', '.join(found)}")
    fields, url, model = found[given.schema], given.url, given.model
    backend = lambda: OllamaBackend(url, model)
    if given.command == "extract":
        out = jobrun.run(store, given.path, given.schema, fields, backend, model=model, pages_spec=given.pages, force=given.force, max_retries=given.retries)
        out.select("job_id", "path", "status", "total_chunks").show(50, truncate=False)
    elif given.command == "resume":
        jobrun.resume(store, given.job_id, fields, backend, given.retries).select("job_id", "status").show(truncate=False)
    else:
        jobrun.retry(store, fields, backend, given.job, given.retries).groupBy("outcome").count().show()
        missing = jobrun.missing_chunks(store).count()
        if missing:
            print(f"{missing} dead letters have no stored chunk", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
