import datetime as dt
import os
import subprocess
import sys

import pytest
from tests.helpers import rows

from touchline.operators.rows import keep_first
from touchline.sources.pages import SCRAPED_COLUMNS, extract_games, scrape
from touchline.streaming.ingest import ingest_new_pages, page_stream


def game(home, away, state, g, scores=("31", "17"), extra=""):
    return f"""
    <div class="game">
      <div class="time"><div class="state">{state}</div><div class="venue"> North Bank Ground </div></div>
      <div class="logo home"><img alt=" {home} "/></div>
      <div class="logo away"><img alt="{away}"></div>
      <div class="game-time">6:45pm</div><div class="round">Week 11</div>
      <div class="score home">{scores[0]}</div><div class="score away">{scores[1]}</div>
      <a class="link-box" href=" https://example.org/match?g={g} "></a>{extra}
    </div>"""


def page(*games, date="Mon Dec 08, 2025"):
    return f"""<html><head><meta charset="utf-8"><style>p {{}}</style></head><body><br>
    <section class="games-list"><div class="games-list-item"><div class="date">{date}</div>
    <div class="comp" data-id="lg-7"><h2>Cup &amp; Shield</h2><div class="games">{''.join(games)}</div></div>
    </div></section></body></html>"""


def pages_of(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")


def dates_of(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "d date")


DAY = dt.date(2025, 12, 8)


def test_one_game(spark):
    df = pages_of(spark, page(game("Herons", "Kestrels", "FT", 90817, extra='<div class="live-note">After extra time</div>')))
    out = scrape(df, "results", "feed", dates_of(spark, DAY))
    assert tuple(out.columns) == SCRAPED_COLUMNS
    assert tuple(out.first()) == (
        "feed", "results", "2025-12-08", "lg-7", "Cup & Shield", "Herons", "Kestrels", 31, 17, "North Bank Ground",
        "6:45pm", "FT", "Week 11", "After extra time", "https://example.org/match?g=90817", "90817",
    )


def test_completed_games_leave_fixtures_only(spark):
    df = pages_of(spark, page(game("A", "B", "FT", 1), game("C", "D", "4:15pm", 2, scores=("", "n/a"))))
    fixtures = extract_games(df, "fixtures", "feed", dates_of(spark, DAY))
    assert rows(fixtures, "home_team", "home_score", "away_score") == [("C", None, None)]
    assert extract_games(df, "results", "feed", dates_of(spark, DAY)).count() == 2


@pytest.mark.parametrize(
    "html",
    [
        "<html><body><p>Fixtures follow on Monday</p></body></html>",
        page(game("A", "B", "FT", 1), date="Mon Dec 09, 2025"),
        page(game("A", "B", "FT", 1), date="8 December 2025"),
        page(),
        "<section class='games-list'><p><div class='games-list-item'></section>",
        "",
        None,
    ],
)
def test_nothing_found(spark, html):
    assert extract_games(pages_of(spark, html), "results", "feed", dates_of(spark, DAY)).isEmpty()


def test_header_date_forms(spark):
    for text in ("Sun Dec 7, 2025", " mon  DEC 07,  2025 "):
        out = extract_games(pages_of(spark, page(game("A", "B", "FT", 1), date=text)), "results", "feed")
        assert rows(out, "match_date") == [("2025-12-07",)], text


def test_missing_parts_are_null(spark):
    bare = '<div class="game"><div class="score">7</div></div>'
    row = extract_games(pages_of(spark, page(bare)), "results", "feed").first().asDict()
    for name in ("home_team", "home_score", "venue", "state", "kickoff_time_local", "match_link", "match_id"):
        assert row[name] is None, name


def test_untidy_markup(spark):
    text = page(game("A", "B", "KO", 1))
    text = text.replace("<body>", "<body><!-- <section class='games-list'> --><script>var t = '<section class=\"games-list\">';</script>")
    text = text.replace('<div class="round">', "<div title=it's a>b class='x round y'>").replace('<img alt=" A "/>', "<IMG ALT='A > B' loose=>")
    text = text.replace('<div class="game-time">', '<p>unclosed<div class=game-time data-x>').replace("</html>", '<div class="game-time" <b')
    row = extract_games(pages_of(spark, text), "results", "feed").first().asDict()
    assert (row["home_team"], row["away_team"], row["match_id"], row["state"]) == ("A > B", "B", "1", "KO")
    assert row["kickoff_time_local"] == "6:45pm"


def test_first_page_wins(spark):
    first, later = page(game("A", "B", "KO", 9)), page(game("Z", "B", "KO", 9), game("C", "D", "KO", 10))
    out = scrape(pages_of(spark, first, later), "results", "feed", dates_of(spark, DAY))
    assert rows(out, "home_team", "match_id") == [("A", "9"), ("C", "10")]


def test_null_ids_count_as_one_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("x", 3)], "match_id string, page_id int")
    assert rows(keep_first(df, "match_id", ["page_id"])) == [("x", 3), (None, 1)]


def test_workers_need_no_installed_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path only."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    html = page(game("A", "B", "KO", 1))
    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {repo!r})
from touchline.session import build_session
from touchline.sources.pages import extract_games
spark = build_session("elsewhere", "local[1]", **{{"spark.ui.enabled": "false"}})
pages = spark.createDataFrame([(1, {html!r})], "page_id bigint, html string")
print("teams", extract_games(pages, "results", "feed").select("home_team").first()[0])
"""
    )
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=240)
    assert "teams A" in done.stdout, done.stderr[-2000:]


def test_stream_takes_each_page_once(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("pages", "bronze", "checkpoint"))
    schema = "page_id bigint, url string, html string"
    html = [page(game("A", "B", "KO", 1)), page(game("C", "D", "KO", 2), game("E", "F", "FT", 3))]
    for number, text in enumerate(html):
        spark.createDataFrame([(number, "u", text)], schema).coalesce(1).write.mode("append").parquet(folder)
        ingest_new_pages(page_stream(spark, folder), "fixtures", "feed", target, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(target), "home_team") == [("A",), ("C",)]
    ingest_new_pages(page_stream(spark, folder), "fixtures", "feed", target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_stream_state_is_kept_by_match_id(spark, tmp_path):
    """Earlier ids, the order within a batch and null ids; no run reads the target."""
    folder, target, checkpoint = (str(tmp_path / n) for n in ("pages", "games", "state"))
    schema = "page_id bigint, url string, html string"
    nameless = game("N", "M", "KO", 1).replace("g=1", "h=1")
    batches = [
        [(5, "u", page(game("late", "B", "KO", 1))), (2, "u", page(game("early", "B", "KO", 1), nameless)), (3, "u", page(nameless))],
        [(1, "u", page(game("again", "B", "KO", 1), game("new", "D", "KO", 2), game("new twice", "D", "KO", 2), nameless))],
    ]
    for found in batches:
        spark.createDataFrame(found, schema).write.mode("append").parquet(folder)
        query = ingest_new_pages(page_stream(spark, folder), "results", "feed", target, checkpoint)
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert target not in plan and "FlatMapGroupsInPandasWithState" in plan
    assert rows(spark.read.parquet(target), "home_team", "match_id") == [("N", None), ("early", "1"), ("new", "2")]
    assert spark.read.parquet(target).columns == list(SCRAPED_COLUMNS)


def test_extraction_reads_no_plan_ahead(spark):
    """A shuffle behind the pages runs with the result only."""
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = pages_of(spark, page(game("A", "B", "FT", 1))).groupBy("page_id").agg({"html": "max"}).withColumnRenamed("max(html)", "html")
    out = extract_games(df, "results", "feed")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert rows(out, "home_team") == rows(extract_games(df, "results", "feed", tasks=3), "home_team") == [("A",)]


def test_stream_state_is_shared_by_groups_of_ids(spark, tmp_path, monkeypatch):
    """Python is called once a group of ids, in which every id, null too, keeps its first record of the first batch."""
    from touchline.streaming import ingest

    monkeypatch.setattr(ingest, "ID_GROUPS", 3)
    folder, target, checkpoint = (str(tmp_path / n) for n in ("pages", "games", "state"))
    schema = "page_id bigint, url string, html string"
    nameless = game("N", "M", "KO", 1).replace("g=1", "h=1")

    def pages_from(first, last, side):
        return [(first + last - n, "u", page(game(f"{side} {n}", "B", "KO", n), nameless)) for n in range(first, last)]

    for found in (pages_from(0, 30, "early") + pages_from(0, 30, "early"), pages_from(20, 50, "late"), pages_from(0, 50, "again")):
        spark.createDataFrame(found, schema).write.mode("append").parquet(folder)
        query = ingest.ingest_new_pages(ingest.page_stream(spark, folder), "results", "feed", target, checkpoint)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    wanted = [(f"{'early' if n < 30 else 'late'} {n}", str(n)) for n in range(50)] + [("N", None)]
    assert sorted(rows(spark.read.parquet(target), "home_team", "match_id"), key=str) == sorted(wanted, key=str)


def test_frequent_tags_are_read_once(monkeypatch):
    from touchline.sources import pages

    read, tag_of = [], pages._tag_of
    monkeypatch.setattr(pages, "_tag_of", lambda token: (read.append(token[0]), tag_of(token))[1])
    monkeypatch.setattr(pages, "_MOST_REMEMBERED", 100)
    html = [page(game(f"A{n}", "B", "KO", n)) for n in range(400)]
    assert [g["home_team"] for text in html for g in pages.games_in_page(text)] == [f" A{n} " for n in range(400)]
    assert len(pages._REMEMBERED) <= 100 and len(read) < 400 * 10  # of 40 tags a page


def test_plain_tags_are_told_from_others():
    """What a tag's own text does not settle is read from the page."""
    from touchline.sources import pages

    for text in ('<div class="a b">', "</div>", "<BR/>", '<a href="x?a=1&amp;b" id="">'):
        assert pages._plain_tag(text) is not None, text
    for text in ("<div class='a'>", '<b a"="x>', '<b title="a>', "<script>", '<style type="x">', "<!-- x -->", "< b>", "<3 <b>", "<p a=1>"):
        assert pages._plain_tag(text) is None, text
    odd = '<p title="a>b">1</p><!-- <p> --><script>"<p>"</script><b a"="x>"y"><3 <i>2</i><!-- open'
    assert [t[2][:2] for t in pages._tokens(odd) if t[2]] == [
        ("p", None), (None, "p"), ("b", None), ("i", None), (None, "i"),
    ]
