from __future__ import annotations

import json

import pytest

from minutespark.__main__ import main, parser

PAGE = "<html><title>第{n}回 審議会</title><body><p>令和7年7月{n}日</p><p>" + "council budget report road {n} " * 80 + "</p></body></html>"


def test_jobs_in_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("EMBED_DIM", "16")
    sample = tmp_path / "sample"
    sample.mkdir()
    for n in range(1, 4):
        (sample / f"{n}.html").write_text(PAGE.replace("{n}", str(n)))
    root = ["--root", str(tmp_path / "tables")]
    run = lambda *a: main([*root, *a], spark)
    assert run("health") == ["ok"]
    assert run("normalize", "--source", "sample", "--sample-dir", str(sample)) == ["ok 3, failed 0, skipped 0"]
    assert run("normalize", "--sample-dir", str(sample)) == ["ok 3, failed 0, skipped 0"]
    first = run("embed")
    assert first[0].startswith("documents 3, chunks ") and run("embed") == first
    assert run("summarize") == ["done 3"]
    assert run("export") == run("export") == ["documents 3"]
    hits = run("keyword", "budget")
    assert len(hits) == 3 and hits[0].startswith("1\tfile://")
    assert run("keyword", "nothing") == ["No results found."]
    found = [json.loads(x) for x in run("search", "council budget", "--top-k", "2")]
    assert len(found) == 2 and set(found[0]) == {"url", "council_name", "date", "chunk_text", "score"}
    assert len(run("summary-search", "council")) == 3
    assert run("search", "council", "--ministry", "") == []
    with pytest.raises(ValueError):
        run("search", " ")
    (tmp_path / "q.csv").write_text("query_id,query_text\n1,council\n2,road report\n")
    assert run("eval", str(tmp_path / "q.csv"), str(tmp_path / "out")) == ["queries 2"]
    rows = spark.read.option("header", True).option("escape", "\"").option("multiLine", True).csv(str(tmp_path / "out"))
    assert rows.columns == ["query_id", "query_text", "run", "rank", "doc_id", "url", "text_or_summary", "score"]
    assert {r.run for r in rows.collect()} == {"chunks", "summaries", "rerank_summaries"}


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["--root", "x", "normalize", "--source", "other"])
