"""Fields of meeting records, as column functions over normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ENDS, W, lines, nfkc, one_line, strip

# They must equal those of the records' publishers and of the jobs
# these functions replace.
#: Era names, and the western year before the era's first.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}
#: Domains and their ministries, in the order of search.
MINISTRY_DOMAINS = {
    "cao.go.jp": "内閣府",
    "kantei.go.jp": "内閣府",
    "soumu.go.jp": "総務省",
    "moj.go.jp": "法務省",
    "mofa.go.jp": "外務省",
    "mof.go.jp": "財務省",
    "mext.go.jp": "文部科学省",
    "mhlw.go.jp": "厚生労働省",
    "maff.go.jp": "農林水産省",
    "meti.go.jp": "経済産業省",
    "mlit.go.jp": "国土交通省",
    "env.go.jp": "環境省",
    "mod.go.jp": "防衛省",
    "digital.go.jp": "デジタル庁",
}
#: Names looked for in texts, in the order of search.
MINISTRY_NAMES = ["内閣府", "総務省", "法務省", "外務省", "財務省", "文部科学省", "厚生労働省", "農林水産省", "経済産業省", "国土交通省", "環境省", "防衛省", "デジタル庁"]
TITLE_WORDS = ["審議会", "委員会", "会議", "部会", "検討会"]
PLACE_WORDS = ["場所", "会場"]
AGENDA_STOPS = ["出席者", "配布資料", "議事", "議事内容", "開会"]
AGENDA = "(議題|議事(?!要旨|概要|録))"
MEETING_NO = rf"第[{W}]*([0-9０-９一二三四五六七八九十百千]+)[{W}]*回"
ATTENDEES = rf"(?d)(出席者|出席委員)[：:\n][{W}]*(.+)"

_D = r"\p{Nd}"
# what may begin a match is told by its first character
ERA_DATE = rf"(?=[{''.join(e[0] for e in ERAS)}])({'|'.join(ERAS)})[{W}]*({_D}+)年[{W}]*({_D}{{1,2}})月[{W}]*({_D}{{1,2}})日"
WESTERN_DATE = rf"(?=[12])((?:20|19){_D}{{2}})[年/\-.][{W}]*({_D}{{1,2}})[月/\-.][{W}]*({_D}{{1,2}})日?"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def _group(x: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, n), F.lit(""))


def parse_date(x: Column, normalized: bool = False) -> Column:
    """The first era date, or if that is none of the calendar the first western one."""
    t = x if normalized else nfkc(x)
    eras = F.create_map(*[F.lit(v) for kv in ERAS.items() for v in kv])
    # the text is searched once for either kind; the parts are read off the short match
    era = _group(t, ERA_DATE, 0)
    year = (F.try_element_at(eras, F.substring(era, 1, 2)) + _group(era, ERA_DATE, 2).try_cast("bigint")).cast("string")
    day = F.concat_ws("-", F.lpad(year, 4, "0"), _group(era, ERA_DATE, 3), _group(era, ERA_DATE, 4))
    western = F.regexp_replace(_group(t, WESTERN_DATE, 0), WESTERN_DATE, "$1-$2-$3")
    found = [F.when(F.contains(t, F.lit("年")) & (F.length(year) <= 4), F.try_to_date(day, "yyyy-M-d")), F.try_to_date(western, "yyyy-M-d")]
    return F.coalesce(*found)


def host(url: Column) -> Column:
    """Lower-case host, without user and port."""
    net = F.lower(F.regexp_extract(url, HOST, 1))
    return F.split_part(F.element_at(F.split(net, "@"), -1), F.lit(":"), F.lit(1))


def ministry_from_url(url: Column) -> Column:
    h = host(url)
    return F.coalesce(*[F.when((h == d) | h.endswith("." + d), F.lit(m)) for d, m in MINISTRY_DOMAINS.items()])


def ministry_from_text(x: Column) -> Column:
    """The first name of the list, not of the text."""
    return F.coalesce(*[F.when(F.contains(x, F.lit(m)), F.lit(m)) for m in MINISTRY_NAMES])


def ministry(url: Column, x: Column) -> Column:
    return F.coalesce(ministry_from_url(url), ministry_from_text(x))


def title(x: Column) -> Column:
    """The first line with a word for meetings, else the first line that is not blank."""
    words = "|".join(TITLE_WORDS)
    # only texts that hold a word are cut into lines
    likely = F.when(x.rlike(words), F.get(F.filter(lines(x), lambda s: s.rlike(words)), F.lit(0)))
    first = _group(x, rf"\A[{W}]*([^{ENDS}]+)", 1)
    return F.substring(strip(F.coalesce(likely, first)), 1, 200)


def meeting_no(x: Column) -> Column:
    return nfkc(_group(x, MEETING_NO, 0))


def location(x: Column) -> Column:
    """What follows the colon of the first line that names a place, else that line; may be empty."""
    words = "|".join(PLACE_WORDS)
    line = F.when(x.rlike(words), F.get(F.filter(lines(x), lambda s: s.rlike(words)), F.lit(0)))
    return F.substring(strip(F.coalesce(F.get(F.split(line, "[:：]", 2), F.lit(1)), line)), 1, 200)


def attendees(x: Column) -> Column:
    names = F.split(F.regexp_extract(x, ATTENDEES, 2), f"[、,{W}]")
    return F.slice(F.filter(names, lambda s: s != ""), 1, 100)


def agenda(x: Column) -> Column:
    """200 characters from the first heading, up to the next one; empty if none, or if the heading itself stops it."""
    # only texts that hold a heading are searched by the pattern; a heading has two characters
    likely = F.contains(x, F.lit("議題")) | F.contains(x, F.lit("議事"))
    snippet = F.when(likely, F.regexp_extract(x, f"(?s){AGENDA}.{{0,198}}", 0)).otherwise("")
    stops = F.filter(F.array(*[F.instr(snippet, k) for k in AGENDA_STOPS]), lambda p: p > 0)
    cut = F.when(F.size(stops) > 0, F.substring(snippet, F.lit(1), F.array_min(stops) - 1)).otherwise(snippet)
    return strip(one_line(cut))


def json_list(x: Column) -> Column:
    return F.to_json(F.coalesce(x, F.array().cast("array<string>")))


def json_agenda(x: Column) -> Column:
    """A JSON string, or an empty JSON list where there is no agenda."""
    quoted = F.to_json(F.array(x))
    return F.when(F.coalesce(x, F.lit("")) == "", "[]").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
