"""Match records from stored result and fixture pages.

Python only walks the markup and hands back text fields, one Arrow batch at a time. Dates,
scores, links, filters and deduplication are Spark expressions on top of that.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import query_parameter, strip
from touchline.operators.rows import exclude_completed, keep_first

# The markup walk travels to the workers with the job: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The scraped record layout, in order.
SCRAPED_COLUMNS = (
    "provider",
    "integration_type",
    "match_date",
    "competition_id",
    "competition_name",
    "home_team",
    "away_team",
    "home_score",
    "away_score",
    "venue",
    "kickoff_time_local",
    "state",
    "round",
    "live_note",
    "match_link",
    "match_id",
)
# Fixed value: elements that never have content.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Fixed value: date header of a block of games.
HEADER_DATE = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)\s+([a-z]{3}\s+\d{1,2},\s+\d{4})$"
GAME_FIELDS = (
    "competition_id",
    "competition_name",
    "state",
    "venue",
    "home_team",
    "away_team",
    "kickoff_time_local",
    "round",
    "live_note",
    "home_score",
    "away_score",
    "match_link",
)
# What a header must hold for the exact pattern to be able to match.
_HEADER = re.compile(r"[A-Za-z]{3}\s+\d{1,2},\s+\d{4}")
GAMES_PER_BATCH = 2_000
_RAW_FIELDS = pa.schema(
    [("page_id", pa.int64()), ("pos", pa.int32()), *[(name, pa.string()) for name in ("header_date", *GAME_FIELDS)]]
)
_RAW_SCHEMA = "page_id bigint, pos int, header_date string, " + ", ".join(f"`{f}` string" for f in GAME_FIELDS)


# One token of markup. Quotes count only in attribute values; possessive quantifiers keep
# malformed pages linear. Groups: raw = script or style, end, start, attributes.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*+>
      | <(?P<raw>script|style)\b[^>]*+>.*?</(?P=raw)\s*+>
      | </(?P<end>[a-z][^\s/>]*+)[^>]*+>
      | <(?P<start>[a-z][^\s/>]*+)
         (?P<attributes>(?:[^\s>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+|[\s/=]++)*+)>
    """,
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r"""([^\s>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))""")


# Anything up to the next ">", and those of them that are a whole tag whatever follows: plain names, values in
# double quotes. Only the others have to be looked at as _TOKEN.
_UP_TO_END = re.compile(r"<[^>]*+>")
_PLAIN_TAG = re.compile(
    r"""</[a-z][a-z0-9-]*+\s*+> | <(?!(?:script|style)\b)[a-z][a-z0-9-]*+(?:\s++[a-z-]++="[^"<>]*+")*+\s*+/?>""",
    re.ASCII | re.IGNORECASE | re.VERBOSE,
)
# Longer tags are read every time they occur, so that what is remembered stays small.
_LONGEST_REMEMBERED = 200


def _attributes(source: str) -> dict[str, str]:
    return {name.lower(): unescape(double or single or bare) for name, double, single, bare in _ATTRIBUTE.findall(source)}


def _tag_of(token: re.Match) -> tuple[str | None, str | None, frozenset[str], str, bool] | None:
    """(start tag, end tag, class names, attributes, takes content) of a token; None for comments and raw content."""
    start, end, source = token["start"], token["end"], token["attributes"]
    if start:
        start = start.lower()
        css = _attributes(source).get("class", "") if source else ""
        return start, None, frozenset([css, *css.split()]), source, start not in VOID_ELEMENTS and not source.endswith("/")
    return (None, end.lower(), frozenset(), "", False) if end else None


# What plain tags say, by their text; at most _MOST_REMEMBERED of them. Every worker fills its own.
_REMEMBERED: dict[str, tuple | None] = {}
_MOST_REMEMBERED = 4_096


def _plain_tag(text: str) -> tuple[str | None, str | None, frozenset[str], str, bool] | None:
    """:func:`_tag_of` a plain tag, else None. A page repeats most of its tags, and so do the pages of a provider."""
    found = _REMEMBERED.get(text, _REMEMBERED)
    if found is _REMEMBERED:  # not there
        found = _tag_of(_TOKEN.match(text)) if _PLAIN_TAG.fullmatch(text) else None
        if len(_REMEMBERED) >= _MOST_REMEMBERED:
            _REMEMBERED.clear()
        _REMEMBERED[text] = found
    return found


def _tokens(html: str) -> Iterator[tuple[int, int, tuple[str | None, str | None, frozenset[str], str, bool] | None]]:
    """Start, end and :func:`_tag_of` every _TOKEN of the page. Plain tags are told by their text alone."""
    read, length = 0, len(html)
    while read < length:
        for rough in _UP_TO_END.finditer(html, read):
            at, after = rough.span()
            found = _plain_tag(rough[0]) if after - at <= _LONGEST_REMEMBERED else None
            if found is None:
                break
            yield at, after, found
            read = after
        token = _TOKEN.search(html, read)
        if token is None:
            return
        yield *token.span(), _tag_of(token)
        read = token.end()


class _Outline:
    """Elements of a page in document order.

    An element's descendants are the elements from its own place up to ``end``, so looking
    inside it is a slice. An end tag closes up to its nearest open start tag.
    """

    def __init__(self, html: str) -> None:
        self.tags: list[str] = []
        self.names: list[frozenset[str]] = []
        self.sources: list[str] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[str] = []
        self.text_starts: list[int] = []
        self.text_ends: list[int] = []
        self._open: list[int] = []
        tags, names, sources, parents, pieces = self.tags, self.names, self.sources, self.parents, self.pieces
        ends, text_starts, text_ends, opened = self.ends, self.text_starts, self.text_ends, self._open
        read = 0
        for at, after, found in _tokens(html):
            if at > read:
                self._add_text(html[read:at])
            read = after
            if found is None:
                continue
            start, end, css, source, takes_content = found
            if start is None:
                if opened and tags[opened[-1]] == end:
                    closed = opened.pop()
                    ends[closed], text_ends[closed] = len(tags), len(pieces)
                else:
                    self._end(end)
                continue
            place = len(tags)
            tags.append(start)
            names.append(css)
            sources.append(source)
            parents.append(opened[-1] if opened else -1)
            ends.append(place + 1)
            text_starts.append(len(pieces))
            text_ends.append(len(pieces))
            if takes_content:
                opened.append(place)
        self._add_text(html[read:])
        self._close_down_to(0)

    def _add_text(self, text: str) -> None:
        text = text.strip()
        if text:
            self.pieces.append(unescape(text).strip())

    def _end(self, tag: str) -> None:
        opened = self._open
        for depth in range(len(opened) - 1, -1, -1):
            if self.tags[opened[depth]] == tag:
                self._close_down_to(depth)
                return

    def _close_down_to(self, depth: int) -> None:
        while len(self._open) > depth:
            place = self._open.pop()
            self.ends[place] = len(self.tags)
            self.text_ends[place] = len(self.pieces)

    def inside(self, place: int, tag: str, css: str | None = None) -> Iterator[int]:
        """Descendants by tag and class. One word may be any class; several are the whole attribute."""
        for at in range(place + 1, self.ends[place]):
            if self.tags[at] == tag and (css is None or css in self.names[at]):
                yield at

    def has_class(self, place: int, css: str) -> bool:
        return css in self.names[place]

    def children(self, place: int, tag: str, css: str) -> Iterator[int]:
        return (at for at in self.inside(place, tag, css) if self.parents[at] == place)

    def first(self, place: int | None, tag: str, css: str | None = None) -> int | None:
        return None if place is None else next(self.inside(place, tag, css), None)

    def text(self, place: int | None) -> str | None:
        return None if place is None else "".join(self.pieces[self.text_starts[place] : self.text_ends[place]])

    def attribute(self, place: int | None, name: str) -> str | None:
        return None if place is None else _attributes(self.sources[place]).get(name)


def _boxes(page: _Outline, game: int) -> tuple[dict[str, int], dict[str, str | None]]:
    """The first block of every class in a game, and the teams by side: the first logo of a side that holds an image."""
    first: dict[str, int] = {}
    logos: dict[str, str | None] = {}
    for box in page.inside(game, "div"):
        names = page.names[box]
        for name in names:
            first.setdefault(name, box)
        if "logo" in names:
            image = page.first(box, "img")
            for side in ("home", "away") if image is not None else ():
                if side in names and side not in logos:
                    logos[side] = page.attribute(image, "alt") or None
    return first, logos


def games_in_page(html: str) -> Iterator[dict[str, str | None]]:
    """Raw text fields of every game block of one page, in page order."""
    page = _Outline(html)
    sections = (at for at, tag in enumerate(page.tags) if tag == "section" and page.has_class(at, "games-list"))
    section = next(sections, None)
    if section is None:
        return
    for item in page.children(section, "div", "games-list-item"):
        header_date = page.text(page.first(item, "div", "date"))
        if header_date is None or not _HEADER.search(header_date):
            continue  # before anything below the header is walked
        for competition in page.children(item, "div", "comp"):
            games = page.first(competition, "div", "games")
            if games is None:
                continue
            shared = {
                "header_date": header_date,
                "competition_id": page.attribute(competition, "data-id"),
                "competition_name": page.text(page.first(competition, "h2")),
            }
            for game in page.inside(games, "div", "game"):
                box, logos = _boxes(page, game)
                when = box.get("time")
                yield {
                    **shared,
                    "state": page.text(page.first(when, "div", "state")),
                    "venue": page.text(page.first(when, "div", "venue")),
                    "home_team": logos.get("home"),
                    "away_team": logos.get("away"),
                    "kickoff_time_local": page.text(box.get("game-time")),
                    "round": page.text(box.get("round")),
                    "live_note": page.text(box.get("live-note")),
                    "home_score": page.text(box.get("score home")),
                    "away_score": page.text(box.get("score away")),
                    "match_link": page.attribute(page.first(game, "a", "link-box"), "href") or None,
                }


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages are decoded one by one, and their games leave in batches of about GAMES_PER_BATCH."""
    columns: dict[str, list] = {field.name: [] for field in _RAW_FIELDS}
    for batch in batches:
        for page_id, html in zip(batch["page_id"], batch["html"]):
            for pos, game in enumerate(games_in_page(html.as_py())):
                for name, value in {"page_id": page_id.as_py(), "pos": pos, **game}.items():
                    columns[name].append(value)
            if len(columns["pos"]) >= GAMES_PER_BATCH:
                yield pa.RecordBatch.from_pydict(columns, schema=_RAW_FIELDS)
                columns = {field.name: [] for field in _RAW_FIELDS}
    yield pa.RecordBatch.from_pydict(columns, schema=_RAW_FIELDS)


def extract_games(
    pages: DataFrame, kind: str, provider: str, dates: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """Scraped records of ``pages`` (page_id, html) with page_id and pos for ordering.

    kind      ``results`` or ``fixtures``; fixtures leave completed games out.
    dates     one date column; only games under these header dates are kept (all when None).
    tasks     deal the pages out to so many tasks before they are parsed; for a few large files, whose
              pieces would leave most cores idle. None shuffles nothing.

    Pages without a game list are dropped before Python sees them. Game blocks under an
    unreadable date header are skipped.
    """
    with_games = pages.where(F.col("html").contains("games-list")).select("page_id", "html")
    if tasks:
        with_games = with_games.repartition(tasks)
    raw = with_games.mapInArrow(_parse_batches, _RAW_SCHEMA)
    # "Sun Dec 7, 2025": the weekday has to be there but does not take part in reading the date.
    header = F.regexp_extract(strip("header_date"), HEADER_DATE, 1)
    day = F.try_to_timestamp(F.regexp_replace(header, r"\s+", " "), F.lit("MMM d, yyyy")).cast("date")
    dated = raw.withColumn("_day", day).where("_day is not null")
    if dates is not None:
        wanted = dates.select(F.col(dates.columns[0]).cast("date").alias("_day")).distinct()
        dated = dated.join(wanted, "_day", "left_semi")

    def score(name: str):
        return F.when(F.col(name).rlike(r"^[0-9]+$"), F.col(name)).try_cast("bigint")

    records = dated.select(
        "page_id",
        "pos",
        F.lit(provider).alias("provider"),
        F.lit(kind).alias("integration_type"),
        F.date_format("_day", "yyyy-MM-dd").alias("match_date"),
        "competition_id",
        "competition_name",
        strip("home_team").alias("home_team"),
        strip("away_team").alias("away_team"),
        score("home_score").alias("home_score"),
        score("away_score").alias("away_score"),
        "venue",
        "kickoff_time_local",
        "state",
        "round",
        "live_note",
        strip("match_link").alias("match_link"),
        query_parameter(strip("match_link"), "g").alias("match_id"),
    )
    return exclude_completed(records)


def scrape(pages: DataFrame, kind: str, provider: str, dates: DataFrame | None = None) -> DataFrame:
    """Extraction plus keep-first deduplication by match id: the bronze record layout."""
    games = extract_games(pages, kind, provider, dates)
    return keep_first(games, "match_id", ["page_id", "pos"]).select(*SCRAPED_COLUMNS)
