"""Command line: ``python -m minutespark JOB --root FOLDER``.

Tables are Parquet folders under the root, named as in ``schemas``; a missing table
is an empty one.  Settings come from the environment.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Settings, clamp_top_k
from .functions.tokens import token_text, tokens
from .operators import search
from .operators.embed import embed_one
from .operators.merge import latest_status, swap_table, table_exists
from .plans import index, jobs
from .sources import tables

log = logging.getLogger("minutespark")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="minutespark", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the tables")
    s = Settings()
    sub = p.add_subparsers(dest="job", required=True)
    n = sub.add_parser("normalize")
    n.add_argument("--source", choices=["db", "sample", "both"], default="both")
    n.add_argument("--limit", type=int, default=s.normalize_limit)
    n.add_argument("--sample-dir", default="sample")
    sub.add_parser("embed").add_argument("--limit-docs", type=int, default=s.embed_limit)
    sub.add_parser("summarize").add_argument("--limit", type=int, default=s.summarize_limit)
    sub.add_parser("export").add_argument("--limit", type=int, default=s.export_limit)
    k = sub.add_parser("keyword")
    k.add_argument("query")
    k.add_argument("--limit", type=int, default=s.keyword_limit)
    for name in ("search", "summary-search"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--top-k", type=int)
        q.add_argument("--ministry")
        if name == "search":
            q.add_argument("--approximate", action="store_true", help="ids and scores by random projections")
    e = sub.add_parser("eval")
    e.add_argument("queries", help="CSV with query_id and query_text")
    e.add_argument("out")
    e.add_argument("--top-k", type=int, default=s.eval_top_k)
    sub.add_parser("health")
    return p


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        if not table_exists(self.spark, self.path(name)):
            log.warning("table %s is missing", name)
            return schemas.empty(self.spark, name)
        return self.spark.read.schema(schemas.TABLES[name]).parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> None:
        swap_table(self.spark, schemas.with_defaults(df), self.path(name))

    def store(self, df: DataFrame) -> DataFrame:
        """A result of this run that is read more than once, as a table that ``close`` removes."""
        path = self.path(f"_run/{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path("_run"))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs one job; returns the lines that it prints."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("minutespark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    t = Tables(spark, args.root)
    try:
        out = run(args, t, Settings())
    finally:
        t.close()
    for line in out:
        print(line)
    return out


def run(args: argparse.Namespace, t: Tables, s: Settings) -> list[str]:
    spark = t.spark
    out: list[str] = []
    if args.job == "health":
        out.append("ok" if search.health(spark) else "failed")
    elif args.job == "normalize":
        samples = tables.sample_files(spark, args.sample_dir) if args.source != "db" else None
        meta, rows = jobs.normalize(t.read("crawled_pages"), samples, t.read("meeting_metadata"), args.source, args.limit, t.store)
        done = jobs.counters(rows).first()
        t.write("meeting_metadata", meta)
        out.append(f"ok {done.ok}, failed {done.ng}, skipped {done.skipped}")
    elif args.job == "embed":
        t.write("meeting_chunks", jobs.embed(t.read("meeting_metadata"), t.read("meeting_chunks"), s, limit=args.limit_docs))
        done = jobs.embed_totals(t.read("meeting_chunks")).first()
        out.append(f"documents {done.docs}, chunks {done.chunks}")
    elif args.job == "summarize":
        tell = lambda status: t.write("chunks_summary_jobs", latest_status(t.read("chunks_summary_jobs").unionByName(status)))
        found, status = jobs.summarise(t.read("meeting_metadata"), t.read("chunks_summary"), s, limit=args.limit, store=t.store, jobs=tell)
        t.write("chunks_summary", found)
        tell(status)
        out += [f"{r.status} {r['count']}" for r in t.read("chunks_summary_jobs").groupBy("status").count().orderBy("status").collect()]
    elif args.job == "export":
        docs = search.export_documents(t.read("meeting_metadata"), t.read("chunks_summary"), token_text, args.limit)
        index.write_index(docs, t.path(s.index_name))
        out.append(f"documents {index.stored_documents(spark, t.path(s.index_name)).count()}")
    elif args.job == "keyword":
        asked = spark.range(1).select(tokens(F.lit(search.check_query(args.query))).alias("t")).first().t
        out += tables.rank_lines(index.search_index(spark, t.path(s.index_name), asked, args.limit))
    elif args.job in ("search", "summary-search"):
        vector = embed_one(spark, search.check_query(args.query), s)
        if getattr(args, "approximate", False):
            out += search.lsh_search(t.read("meeting_chunks"), vector, clamp_top_k(args.top_k)).toJSON().collect()
            return out
        find, rows = (search.search_chunks, "meeting_chunks") if args.job == "search" else (search.search_summaries, "chunks_summary")
        out += find(t.read(rows), t.read("meeting_metadata"), vector, args.top_k, args.ministry).toJSON().collect()
    elif args.job == "eval":
        asked = tables.eval_queries(spark, args.queries).filter(F.trim("query_text") != "").collect()
        queries = [(r.query_id, r.query_text, embed_one(spark, r.query_text, s)) for r in asked]
        found = search.compare_runs(t.read("meeting_chunks"), t.read("chunks_summary"), t.read("meeting_metadata"), queries, tokens, args.top_k, t.store)
        tables.write_eval_csv(found.orderBy("query_id", "run", "rank"), args.out)
        out.append(f"queries {len(queries)}")
    return out


if __name__ == "__main__":
    logging.basicConfig(level=os.environ.get("LOG_LEVEL", "INFO"))
    main(sys.argv[1:])
