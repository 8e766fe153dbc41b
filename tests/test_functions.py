from __future__ import annotations

import datetime
import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from minutespark.config import Settings, clamp_top_k
from minutespark.functions import chunk, extract, ids, text, tokens, vector


def one(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_clean_and_normalize(spark):
    got = one(spark, ["a  b\n- 12 -\n\n\n\nｃ", "  a  b \n- 12 -\n", None, "", "　x　\r\ny\x85z"], text.clean_text(F.col("x")), text.normalize_text(F.col("x")))
    assert got[0][0] == "a b\n\nc"
    assert got[1] == ("a b", "a b\n- 12 -")
    assert got[2] == got[3] == ("", "")
    assert got[4][0] == "x\ny\nz"


def test_dates(spark):
    cases = {
        "令和7年7月23日": datetime.date(2025, 7, 23),
        "令和７年７月２３日": datetime.date(2025, 7, 23),
        "平成31年4月30日": datetime.date(2019, 4, 30),
        "昭和64年1月7日": datetime.date(1989, 1, 7),
        "2025年7月23日": datetime.date(2025, 7, 23),
        "2025/07/23": datetime.date(2025, 7, 23),
        "2025.7.23": datetime.date(2025, 7, 23),
        "令和7年13月1日 2024-02-03": datetime.date(2024, 2, 3),
        "令和元年5月1日": None,
        "2025-02-30": None,
        "令和99999999999999999999年1月1日": None,
        "": None,
    }
    assert one(spark, list(cases), extract.parse_date(F.col("x"))) == list(cases.values())


def test_ministries(spark):
    urls = {"https://www.mhlw.go.jp:443/x": "厚生労働省", "https://a_b.mof.go.jp/": "財務省", "https://u@mof.go.jp/": "財務省", "https://xmof.go.jp/": None, "https://mof.go.jp.example.com/": None, "": None}
    assert one(spark, list(urls), extract.ministry_from_url(F.col("x"))) == list(urls.values())
    assert one(spark, ["環境省と総務省", "なし"], extract.ministry_from_text(F.col("x"))) == ["総務省", None]


def test_fields(spark):
    assert one(spark, ["\n資料\n第3回 情報審議会\n", "資料\n本文", "", "あ" * 300], extract.title(F.col("x"))) == ["第3回 情報審議会", "資料", None, "あ" * 200]
    assert one(spark, ["第 １２ 回", "第百三回", "第回"], extract.meeting_no(F.col("x"))) == ["第 12 回", "第百三回", None]
    assert one(spark, ["場所: 東京: 3階", "会場 大会議室", "場所:", "他"], extract.location(F.col("x"))) == ["東京: 3階", "会場 大会議室", "", None]
    assert one(spark, ["出席者: 山田、佐藤, 鈴木", "出席委員\n山田 佐藤\n次の行", "無"], extract.attendees(F.col("x"))) == [["山田", "佐藤", "鈴木"], ["山田", "佐藤"], []]
    assert one(spark, ["議題 予算 開会 10時", "議事録 … 議題 A", "議事 A", "", "😀議題 𠮷\nB"], extract.agenda(F.col("x"))) == ["議題 予算", "議題 A", "", "", "議題 𠮷 B"]
    assert one(spark, ['a"b', "", None], extract.json_agenda(F.col("x"))) == ['"a\\"b"', "[]", "[]"]


def test_uuid5(spark):
    urls = ["https://example.com/", "https://example.go.jp/会議", "ｈｔｔｐ：//x"]
    assert one(spark, urls, ids.uuid5_url(text.nfkc(F.col("x")))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, unicodedata.normalize("NFKC", u))) for u in urls]
    assert one(spark, [str(uuid.uuid4()), "x", None], ids.is_uuid(F.col("x"))) == [True, False, False]


def chunk_loop(t: str, target: int, overlap: int) -> list[str]:
    t, out, s = t.strip(), [], 0
    overlap = min(overlap, target - 1)
    while t:
        e = min(s + target, len(t))
        if t[s:e].strip():
            out.append(t[s:e].strip())
        if e == len(t):
            break
        s = e - overlap
    return out


def test_chunks(spark):
    rng = random.Random(5)
    texts = ["", " ", "a" * 2500, "あ" * 1000] + ["".join(rng.choice("ab \n😀") for _ in range(rng.randrange(90))) for _ in range(60)]
    for target, overlap in ((1000, 100), (7, 3), (5, 9), (1, 0), (10, 0)):
        assert one(spark, texts, chunk.chunk_array(F.col("x"), target, overlap)) == [chunk_loop(t, target, overlap) for t in texts]
    with pytest.raises(ValueError):
        chunk.chunk_array(F.col("x"), 0)
    with pytest.raises(ValueError):
        chunk.chunk_array(F.col("x"), 5, -1)


def test_sentence_chunks(spark):
    assert chunk.sentence_chunks("x" * 1500) == ["x" * 1500]
    body = ("文" * 99 + "。") * 60
    parts = chunk.sentence_chunks(body)
    assert all(p.endswith("。") and len(p) <= 2000 for p in parts)
    assert parts[1].startswith(parts[0][-200:])
    assert one(spark, [body], chunk.sentence_chunk_array(F.col("x"))) == [parts]
    # no overlap behind short chunks, and no loop that stands still
    assert "".join(chunk.sentence_chunks(body, 100, 300)) == body
    assert one(spark, ["a\n\n b \n\n\n\nc"], chunk.paragraphs(F.col("x"))) == [["a", "b", "c"]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vector.l2_norm(F.col("a")), vector.cosine(F.col("a"), F.col("b")), vector.to_text(F.col("a")), vector.has_dim(F.col("a"), 2)).collect()
    assert got[0][0] == 5 and abs(got[0][1] - 0.96) < 1e-9 and got[0][2] == "[3.00000000, 4.00000000]"
    assert got[1][0] == 1 and got[1][1] is None


def test_vector_text_rounds_as_c(spark):
    """Halves to even, of the binary value; Python's format is C's."""
    rng = random.Random(5)
    ties = [k / 512 for k in range(-600, 600)] + [(2 * k + 1) / 2**10 for k in range(-50, 50)]
    rest = [rng.gauss(0, 10 ** rng.randint(-9, 6)) for _ in range(2000)] + [-0.0, -1e-9, 1.5e-8, 2.5e-8, 1234.5, 16777215.0]
    rows = spark.createDataFrame([(ties + rest, ties + rest)], "f array<float>, d array<double>")
    r = rows.select("f", "d", vector.to_text(F.col("f")).alias("ft"), vector.to_text(F.col("d")).alias("dt"), F.size(vector.from_text(vector.to_text(F.col("f")))).alias("n")).first()
    assert r.ft == "[" + ", ".join(f"{x:.8f}" for x in r.f) + "]"
    assert r.dt == "[" + ", ".join(f"{x:.8f}" for x in r.d) + "]"
    assert r.n == len(r.f)
    assert spark.range(1).select(vector.to_text(F.array(F.lit(float("inf")), F.lit(float("nan"))))).first()[0] == "[Infinity, NaN]"


def test_tokens(spark):
    assert one(spark, ["Hello 東京都庁 ひらがなABC", None, ""], tokens.tokens(F.col("x"))) == [["hello", "東京", "京都", "都庁", "ひらがな", "abc"], [], []]


def test_settings(monkeypatch):
    assert [clamp_top_k(k) for k in (None, 0, -1, 5, 101)] == [5, 5, 1, 5, 100]
    monkeypatch.setenv("EMBED_DIM", "64")
    assert Settings().embed_dim == 64
    with pytest.raises(ValueError):
        Settings(provider="other")


def lines_model(x, clean):
    """What clean_text and normalize_text do, line by line in Python."""
    out = []
    for line in unicodedata.normalize("NFKC", x).splitlines():
        line = line.strip() if clean else line.rstrip()
        if clean and re.fullmatch(r"-?\s*\d+\s*-?", line):
            continue
        out.append(re.sub(r"\s+", " ", line))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def test_cleaning_equals_the_model(spark):
    rng = random.Random(9)
    pieces = [" ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\u2028", "　", "\xa0", "-", "12", "３", "- 4 -", "a", "b c", "会議", "٣", "7-", "--8", "５ -"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + ["", "\n", "1\n2\n3", "a\n1\n\n2\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    for r in df.select("i", text.clean_text(F.col("x")).alias("c"), text.normalize_text(F.col("x")).alias("n")).collect():
        assert r.c == lines_model(texts[r.i], True), repr(texts[r.i])
        assert r.n == lines_model(texts[r.i], False), repr(texts[r.i])


def test_cleaning_again_changes_nothing(spark):
    rng = random.Random(10)
    pieces = [" ", "\t", "\n", "\n\n", "\r", "\x0b", "\x1f", "\x85", "　", "-", "12", "３", "- 4 -", "-  5 -", "a", "会議", "\u0301", "ﾞ", "ｶ", "㌔", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", text.clean_text(F.col("x")).alias("c"))
    for r in df.withColumn("again", text.clean_text(F.col("c"))).collect():
        assert r.again == r.c, repr(texts[r.i])


def test_sentence_chunks_by_their_rules():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(0, 9000)
        body = "".join("。" if rng.random() < 0.005 else "x" for _ in range(n))
        size, overlap = rng.choice([(2000, 200), (1600, 0), (400, 50)])
        got = chunk.sentence_chunks(body, size, overlap)
        if n <= chunk.MIN_SIZE:
            assert got == [body]
            continue
        start = 0
        for i, c in enumerate(got):
            window = body[start : start + size]
            assert window.startswith(c)
            later = window[len(c) :]
            if later:  # cut short: behind the last full stop, which is near the window's end
                assert c.endswith("。") and "。" not in later and len(later) <= chunk.REACH
            else:
                assert c.endswith("。") or "。" not in c[-chunk.REACH - 1 :]
            end = start + len(c)
            assert (end == n) == (i == len(got) - 1)
            start = max(start + 1, end - (overlap if len(c) >= chunk.MIN_SIZE else 0))
    assert chunk.sentence_chunks(None) == [""] and chunk.sentence_chunks(" " + "x" * 3000, 0) == ["x" * 3000]
