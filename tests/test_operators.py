from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from minutespark import schemas
from minutespark.config import Settings
from minutespark.functions import tokens
from minutespark.operators import bm25, embed, merge, queues, search, summarize
from minutespark.plans import jobs
from minutespark.sources import parse, tables
from minutespark.streaming import incremental

HTML = "<html><head><title>第3回 審議会</title><script>x</script></head><body><p>日時: 令和7年7月23日</p><!-- c --><p>場所: 東京</p><p>出席者: 山田、佐藤</p><p>議題 予算</p></body></html>"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def pages(spark, rows):
    df = spark.createDataFrame([(i, u, k, c) for i, (u, k, c) in enumerate(rows)], "id long, url string, content_type string, content binary")
    return df.withColumns({"html_title": F.lit(None).cast("string"), "fetched_at": F.timestamp_seconds("id")})


def test_queues(spark):
    p = pages(spark, [(f"u{i}", "text/html", b"x") for i in range(5)])
    known = spark.createDataFrame([("u1",)], "url string")
    found = queues.pending_pages(p, known, 2)
    assert [r.url for r in found.collect()] == ["u4", "u3"]
    assert "LeftAnti" in plan(found) and "TakeOrderedAndProject" in plan(found)
    docs = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y"), ("d", None)], "doc_id string, discussion_text string")
    done = spark.createDataFrame([("c",)], "doc_id string")
    assert [r.doc_id for r in queues.pending_embed(docs, done).collect()] == ["a"]
    failed = spark.createDataFrame([("a", "error")], "doc_id string, status string")
    assert queues.pending_summary(docs, done, jobs=failed, attempts=1).isEmpty()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("u1", "d1", "m"), ("u2", "d2", "m")], "url string, doc_id string, ministry string")
    new = spark.createDataFrame([("u2", "x2", None), ("u3", "x3", "n")], "url string, doc_id string, ministry string")
    once = merge.upsert_metadata(old, new)
    want = [("u1", "d1", "m"), ("u2", "d2", None), ("u3", "x3", "n")]
    assert sorted(map(tuple, once.collect()), key=str) == want
    assert sorted(map(tuple, merge.upsert_metadata(once, new).collect()), key=str) == want


def test_swap_table(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.swap_table(spark, spark.range(3), path)
    merge.swap_table(spark, spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_swap_that_stops_between_its_renames(spark, tmp_path):
    path = tmp_path / "t"
    merge.swap_table(spark, spark.range(3), str(path))
    spark.range(9).write.parquet(str(tmp_path / "t.new-x"))
    path.rename(tmp_path / "t.old-x")  # the stop: the new table is not in its place yet
    assert merge.table_exists(spark, str(path)) and spark.read.parquet(str(path)).count() == 3
    path.rename(tmp_path / "t.old-x")
    merge.swap_table(spark, spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5
    assert not merge.table_exists(spark, str(tmp_path / "none"))


def test_stream_after_a_stop_keeps_earlier_rows(spark, tmp_path):
    make = lambda i: spark.createDataFrame([(i, f"https://www.mof.go.jp/{i}", None, 200, "text/html", bytearray(HTML.encode()), None, 0)], "id long, url string, referrer_anchor_text string, status_code int, content_type string, content binary, html_title string, depth int").withColumn("fetched_at", F.timestamp_seconds(F.lit(0)))
    place = [str(tmp_path / x) for x in ("in", "meta", "check")]
    make(1).write.parquet(place[0])
    incremental.run_available(spark, *place)
    (tmp_path / "meta").rename(tmp_path / "meta.old-1")
    make(2).write.mode("append").parquet(place[0])
    incremental.run_available(spark, *place)
    assert spark.read.parquet(place[1]).count() == 2


def test_upsert_refuses_unsound_keys(spark):
    one = spark.createDataFrame([("u", "d", "m")], "url string, doc_id string, ministry string")
    for bad in (one.union(one), spark.createDataFrame([(None, "d", "m")], one.schema)):
        for old, new in ((one, bad), (bad, one.limit(0))):
            with pytest.raises(Exception, match="null or repeated"):
                merge.upsert_metadata(old, new).collect()


def test_chunk_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(f"d{i % 700:03d}", i // 700) for i in range(2000)], "doc_id string, pos int")
    got = merge.with_chunk_ids(rows, 5).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: (r.doc_id, r.pos))] == list(range(5, 2005))
    assert merge.with_chunk_ids(rows.limit(0)).isEmpty()


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE d4 LOCATION '{tmp_path}'")
    try:
        schemas.create_tables(spark, "d4", buckets=4)
        schemas.create_tables(spark, "d4", buckets=4)
        assert schemas.read_table(spark, "d4.none.meeting_chunks".replace(".none", "")).isEmpty()
        spark.createDataFrame([("a", "u")], "doc_id string, url string").createOrReplaceTempView("m")
        spark.sql("INSERT INTO d4.meeting_metadata (doc_id, url) SELECT * FROM m")
        spark.sql("INSERT INTO d4.meeting_chunks (chunk_id, doc_id, chunk_text) VALUES (1, 'a', 'x'), (2, 'b', 'y')")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("d4.meeting_chunks").join(spark.table("d4.meeting_metadata"), "doc_id")
        assert "Exchange" not in plan(joined) and joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE d4 CASCADE")


def test_parse(spark):
    rows = pages(spark, [("a", "text/HTML; x", HTML.encode()), ("b", None, b"plain \xff text"), ("c", "application/pdf", b"%PDF"), ("d", "text/html", None)])
    got = {r.url: r.text for r in parse.parse_content(rows).collect()}
    assert got["a"].startswith("第3回 審議会\n第3回 審議会\n日時: 令和7年7月23日\n場所: 東京")
    assert got["b"] == "plain text" and got["c"] == got["d"] == ""


def test_references_without_semicolon():
    page = "<title>A &amp;&amp &quot</title><script>a && b</script><p a='&amp'>&copy 1 &copy; &#38; &#38 &x26; &#x26; &ampx; & &nope; &amp;quot;</p>\n&"
    assert parse.html_text(page.encode()).split("\n") == ['A && "', 'A && "', "© 1 © & & &x26; & &x; & &nope; &quot;", "", "&"]
    assert parse.html_text(page.encode(), ended=True).split("\n") == ["A &&amp &quot", "A &&amp &quot", "&copy 1 © & &#38 &x26; & &ampx; & &nope; &quot;", "", "&"]


def test_cut_references_in_pages_equal_the_sql(spark, tmp_path):
    import duckdb

    from minutespark.catalog import ORACLES, QUERIES

    cut = [f"<!DOCTYPE html><html><head><title>T &amp; x{t}</title></head><body><p>y {t}</p><!-- c --></body></html>" for t in ("&amp;&amp", "&am", "&", "&quot", "&copy", "&middot 1")]
    spark.createDataFrame([(i, f"https://e/{i}", h) for i, h in enumerate(cut)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {r[0]: r[1] for r in con.execute(f"SELECT page_id, text FROM ({ORACLES['html_text']})").fetchall()}
    assert {r.page_id: r.text for r in QUERIES["html_text"](spark, str(tmp_path)).collect()} == want


def test_normalize_job(spark):
    p = pages(spark, [("https://www.mof.go.jp/x", "text/html", HTML.encode()), ("", "text/html", b"y")])
    table, rows = jobs.normalize(p, None, schemas.empty(spark, "meeting_metadata"), "db")
    r = table.first()
    assert (r.ministry, r.council_name, r.meeting_no, str(r.date), r.location, r.attendees, r.agenda) == ("財務省", "第3回 審議会", "第3回", "2025-07-23", "東京", ["山田", "佐藤"], "議題 予算")
    assert tuple(jobs.counters(rows).first()) == (1, 0, 1)
    with pytest.raises(ValueError):
        jobs.normalize(p, None, table, "other")


def test_pages_that_share_a_url(spark):
    """Each has its row and its count; the table gets the newest, a sample before all."""
    p = pages(spark, [("https://e/a", "text/html", b"old"), ("https://e/b", "text/html", b"b"), ("https://e/a", "text/html", b"new")])
    none = schemas.empty(spark, "meeting_metadata")
    assert sorted((r.url[-1], r.discussion_text) for r in jobs.normalize_pages(p, none).collect()) == [("a", "new"), ("a", "old"), ("b", "b")]
    table, rows = jobs.normalize(p, None, none, "db")
    assert sorted((r.url[-1], r.discussion_text) for r in table.collect()) == [("a", "new"), ("b", "b")]
    assert tuple(jobs.counters(rows).first()) == (3, 0, 0) and "id" not in rows.columns
    sample = spark.createDataFrame([("https://e/a", "sample")], "url string, text string")
    table, rows = jobs.normalize(p, sample, none, "both")
    assert sorted((r.url[-1], r.discussion_text) for r in table.collect()) == [("a", "sample"), ("b", "b")]
    assert tuple(jobs.counters(rows).first()) == (4, 0, 0)


def test_normalized_pages_equal_the_sql(spark, tmp_path):
    import duckdb

    from minutespark.catalog import ORACLES, QUERIES

    rows = [(i, f"https://e/{i % 4}", f"<!DOCTYPE html><html><head><title>T &amp; x &amp</title></head><body><p>y {i}</p></body></html>") for i in range(10)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = QUERIES["pages_normalized"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['pages_normalized']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_texts_are_cleaned_once(spark):
    """Not once for each field that is read off them."""
    p = pages(spark, [("https://e/a", "text/html", b"x")])
    samples = spark.createDataFrame([("https://e/a", "x")], "url string, text string")
    for df, kinds in ((jobs.normalize_pages(p, schemas.empty(spark, "meeting_metadata")), 3), (jobs.metadata_rows(samples), 1)):
        found = df._jdf.queryExecution().optimizedPlan().toString()
        assert found.count("(?md)^-?") <= kinds, found.count("(?md)^-?")  # a branch for each of three kinds of content


def test_title_and_text_give_different_fields(spark):
    """Date, council and ministry come from the title as it stands, then the text; the number from the text alone."""
    rows = [("https://e/1", "本文のみ", "第５回　情報審議会　令和7年7月23日"), ("https://e/2", "第２回 部会\n2024年1月2日", "環境省の資料"), ("https://e/3", "第２回 部会", None)]
    df = spark.createDataFrame(rows, "url string, text string, html_title string")
    got = {r.url[-1]: (r.ministry, r.council_name, r.meeting_no, r.date and str(r.date)) for r in jobs.metadata_rows(df).collect()}
    assert got == {"1": (None, "第５回　情報審議会　令和7年7月23日", None, "2025-07-23"), "2": ("環境省", "第2回 部会", "第2回", "2024-01-02"), "3": (None, "第2回 部会", "第2回", None)}


def test_pdf_reaches_the_metadata(spark):
    p = pages(spark, [("https://www.mof.go.jp/a.pdf", "application/pdf", "%PDF第1回 会議".encode()), ("https://e/b", None, b"x")])
    parsed = parse.parse_content(p, lambda b: b.decode().removeprefix("%PDF") + "\n令和7年7月23日" if b.startswith(b"%PDF") else "")
    got = {r.url: r for r in jobs.metadata_rows(parsed.select("url", "text", "html_title")).collect()}
    assert got["https://www.mof.go.jp/a.pdf"].meeting_no == "第1回" and str(got["https://www.mof.go.jp/a.pdf"].date) == "2025-07-23"
    assert got["https://e/b"].discussion_text == "x"


def test_embed_job(spark):
    meta = spark.createDataFrame([("a", "x" * 1500), ("b", "y")], "doc_id string, discussion_text string")
    chunks = schemas.empty(spark, "meeting_chunks")
    s = Settings(embed_dim=16)
    done = jobs.embed(meta, chunks, s)
    rows = sorted(done.collect(), key=lambda r: r.chunk_id)
    assert [(r.chunk_id, r.doc_id, len(r.chunk_text)) for r in rows] == [(1, "a", 1000), (2, "a", 600), (3, "b", 1)]
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5
    assert tuple(jobs.embed_totals(done).first()) == (2, 3)
    assert jobs.embed(meta, done, s).count() == 3
    assert embed.embed_one(spark, "y", s) == pytest.approx(rows[2].embedding)
    with pytest.raises(ValueError):
        embed.embed_one(spark, " ", s)


def test_retry():
    calls, waits = [], []

    def fail():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        embed.with_retry(fail, 8, waits.append)
    assert len(calls) == 8 and waits == [1, 2, 4, 8, 16, 32, 60]
    seen = []
    provider = embed.RemoteProvider(lambda t: seen.append(len(t)) or [[0.0]] * len(t))
    assert len(provider.embed(["x"] * 250)) == 250 and seen == [100, 100, 50]


def test_summarize(spark):
    # local classes travel to the workers by value
    class Stubborn(summarize.Extractive):
        """Its first reduce is too short."""

        def reduce(self, partials, note=None):
            if partials[0].startswith("Keep to the limits"):
                return json.dumps({"summary": "s" * 200, "topics": ["A", "a ", "Ｂ", "c", 1]})
            return json.dumps({"summary": "short", "topics": []})

    meta = spark.createDataFrame([("a", "council meeting budget report " * 90), ("b", "tiny"), ("c", "")], "doc_id string, discussion_text string")
    got = {r.doc_id: r for r in summarize.summarize(meta).collect()}
    assert got["a"].status == "done" and 3 <= len(got["a"].topics) <= 8
    assert got["b"].status == "error" and got["b"].error == "no chunks"
    again = {r.doc_id: r for r in summarize.summarize(meta, Stubborn()).collect()}
    assert again["a"].topics == ["a", "b", "c"]
    calls = []

    class Counting(summarize.Extractive):
        def reduce(self, partials, note=None):
            calls.append(len(partials))
            return super().reduce(partials, note)

    summarize.reduce_levels(Counting(), ["p"] * 25, 1)
    assert calls == [10, 10, 5, 3]
    for summary, ok in (("x" * 99, False), ("x" * 100, True), ("x" * 1500, True), ("x" * 1501, False)):
        if ok:
            summarize.validate({"summary": summary, "topics": ["a", "b", "c"]})
        else:
            with pytest.raises(ValueError):
                summarize.validate({"summary": summary, "topics": ["a", "b", "c"]})
    with pytest.raises(ValueError):
        summarize.parse_json_strict("[1]")


def test_model_is_asked_once(spark, tmp_path):
    """Each chunk is mapped once, though two tables are made of it, and no reduce is asked for a failed document."""
    log = str(tmp_path / "asked")

    class Noting(summarize.Extractive):
        def note(self, what):
            with open(log, "a") as f:
                f.write(what + "\n")

        def map_chunk(self, chunk, nudge=False):
            self.note("map " + chunk[:1])
            if chunk.startswith("bad"):
                raise ValueError("no")
            return super().map_chunk(chunk)

        def reduce(self, partials, note=None):
            self.note("reduce " + (partials[0] if len(partials) else "")[:1])
            return super().reduce(partials)

    meta = spark.createDataFrame([("a", "council meeting budget report " * 30), ("b", "bad document of the council " * 30)], "doc_id string, discussion_text string")
    n = iter(range(9))

    def store(df):
        df.write.parquet(path := str(tmp_path / f"s{next(n)}"))
        return spark.read.parquet(path)

    seen = []
    s = Settings(embed_dim=16, retry_max=1)
    found, status = jobs.summarise(meta, schemas.empty(spark, "chunks_summary"), s, Noting(), store=store, jobs=lambda df: seen.append([r.status for r in df.collect()]))
    assert found.count() == 1 and sorted(r.status for r in status.collect()) == ["done", "error"]
    assert seen == [["running", "running"]]
    with open(log) as f:
        asked = f.read().split("\n")
    assert asked.count("map c") == 1 and asked.count("map b") == 2 and asked.count("reduce c") == 1 and asked.count("reduce b") == 0


def test_chat_client():
    asked = []

    def connect():
        def client(messages, model, timeout, response_format):
            asked.append((messages[1]["content"], model, timeout, response_format["type"]))
            return '{"summary": "s", "topics": []}'

        return client

    import pickle

    chat = pickle.loads(pickle.dumps(summarize.Chat(int, "m", 5.0)))
    chat.connect = connect
    assert json.loads(chat.map_chunk("text", nudge=True))["summary"] == "s" and chat.reduce(["a", "b"], "note")
    assert asked[0][1:] == ("m", 5.0, "json_object") and "text" in asked[0][0] and "- a\n- b" in asked[1][0] and "note" in asked[1][0]


def test_local_model_falls_back_to_digests(spark):
    assert embed.LocalModel.find("no such model") is None
    s = Settings(embed_dim=20, embedding_model="no such model")
    assert len(embed.embed_one(spark, "x", s)) == 20


def test_approximate_search_finds_most(spark):
    import random

    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centers[i % 20]]) for i in range(1000)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    hits = 0
    for q in range(10):
        exact = {r.chunk_id for r in search.batch_search(df, [("q", centers[q])], 5).collect()}
        hits += len(exact & {r.chunk_id for r in search.lsh_search(df, centers[q]).collect()})
    assert hits >= 45


def test_batch_search_with_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(2)
    got = search.batch_search(df, [("q", [1.0, 0.0]), ("z", [0.0, 0.0])], 4, "id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score if r.score is None else round(r.score, 3)) for r in got] == [("q", "a", 1.0), ("q", "b", 1.0), ("q", "f", 0.707), ("q", "c", None), ("z", "a", None), ("z", "b", None), ("z", "c", None), ("z", "d", None)]
    assert search.batch_search(df, [], 4, "id").isEmpty() and search.batch_search(df.limit(0), [("q", [1.0, 0.0])], 4, "id").isEmpty()


def test_search(spark):
    meta = spark.createDataFrame([("a", "ua", "", "c", None), ("b", "ub", "m", "c", None)], "doc_id string, url string, ministry string, council_name string, date date")
    chunks = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (2, "b", "y", [1.0, 0.0]), (3, "b", "z", [0.0, 0.0])], "chunk_id long, doc_id string, chunk_text string, embedding array<float>")
    found = search.search_chunks(chunks, meta, [1.0, 0.0], 0)
    assert [(r.url, r.chunk_text, r.score) for r in found.collect()] == [("ua", "x", 1.0), ("ub", "y", 1.0), ("ub", "z", None)]
    assert [r.url for r in search.search_chunks(chunks, meta, [1.0, 0.0], ministry="").collect()] == ["ua"]
    many = search.batch_search(chunks, [("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], 1)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in many.collect()} == {("q1", 1, 1), ("q2", 1, 1)}
    assert "WindowGroupLimit" in plan(many) and "Cartesian" not in plan(many)
    with pytest.raises(ValueError):
        search.check_query(" ")
    assert tables.rank_lines(spark.createDataFrame([], "rank int, url string")) == ["No results found."]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25.search(docs, tokens.tokens(F.col("text")), ["b", "zz"]).collect()}
    assert set(got) == {1} and got[1] > 0


def test_samples_and_stream(spark, tmp_path):
    folder = tmp_path / "sample" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.TXT").write_bytes("第1回 会議\xff".encode("latin-1", "ignore") or b"x")
    (folder / "b.html").write_text(HTML)
    (folder / "c.bin").write_bytes(b"no")
    got = {r.url for r in tables.sample_files(spark, str(tmp_path / "sample")).collect()}
    assert got == {"file://sub/a.TXT", "file://sub/b.html"}
    assert tables.sample_files(spark, str(tmp_path / "none")).isEmpty()

    rows = spark.createDataFrame([(1, "https://www.mof.go.jp/1", None, 200, "text/html", bytearray(HTML.encode()), None, 0)], "id long, url string, referrer_anchor_text string, status_code int, content_type string, content binary, html_title string, depth int").withColumn("fetched_at", F.timestamp_seconds(F.lit(0)))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.run_available(spark, str(tmp_path / "in"), str(tmp_path / "meta"), str(tmp_path / "check"))
        assert spark.read.parquet(str(tmp_path / "meta")).count() == 1
