"""Reference SQL for the registered queries, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

# Shared views; each may use the ones listed before it.
_VIEWS = {
    "matches": """
        SELECT o_orderkey AS ID, o_orderdate AS MatchDate,
               'NATION_' || (o_custkey % 25) AS HomeTeam,
               'NATION_' || ((o_custkey // 25 + o_orderkey) % 25) AS AwayTeam,
               CAST(floor(o_totalprice) AS BIGINT) % 50 AS HomeScore,
               (o_orderkey * 13) % 50 AS AwayScore,
               upper(CASE o_orderpriority WHEN '1-URGENT' THEN 'Rugby World Cup' WHEN '2-HIGH' THEN 'Six Nations'
                     WHEN '3-MEDIUM' THEN 'United Rugby Championship' WHEN '4-NOT SPECIFIED' THEN 'Internationals'
                     ELSE 'Club Friendly' END) AS CompetitionName,
               'Supplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0') AS Venue
        FROM orders
        WHERE o_custkey % 25 <> (o_custkey // 25 + o_orderkey) % 25""",
    "results": "SELECT * FROM matches WHERE MatchDate < TIMESTAMP '2001-01-01'",
    "fixtures": """
        SELECT ID, MatchDate, HomeTeam, AwayTeam, CompetitionName, Venue,
               MatchDate + to_hours(CAST(ID % 12 AS INTEGER)) AS KickoffTimeLocal
        FROM matches WHERE MatchDate >= TIMESTAMP '2001-01-01'""",
    "scraped": """
        SELECT o_orderkey AS record,
               CASE WHEN o_orderkey % 2 = 0 THEN 'fixtures' ELSE 'results' END AS integration_type,
               CASE WHEN o_custkey % 97 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS match_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Rugby World Cup' WHEN '2-HIGH' THEN 'Six Nations'
                    WHEN '3-MEDIUM' THEN 'United Rugby Championship' WHEN '4-NOT SPECIFIED' THEN 'Internationals'
                    ELSE 'Club Friendly' END AS competition_name,
               'Nation_' || (o_custkey % 25) AS home_team,
               'Nation_' || ((o_custkey // 25 + o_orderkey) % 25) AS away_team,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) % 50 END AS home_score,
               CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey * 13) % 50 END AS away_score,
               ' supplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0') || ' ' AS venue,
               CASE o_orderstatus
                    WHEN 'O' THEN (o_orderkey % 12 + 1) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || 'PM'
                    WHEN 'F' THEN (o_orderkey % 12 + 1) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || 'am'
                    ELSE 'TBC' END AS kickoff_time_local,
               CASE o_orderstatus WHEN 'F' THEN 'FT' WHEN 'O' THEN 'KO' END AS state,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS match_id,
               o_orderkey // 100 AS page_id, o_orderkey % 100 AS pos
        FROM orders, (VALUES (1), (2)) copies(copy_number)
        WHERE o_custkey % 25 <> (o_custkey // 25 + o_orderkey) % 25
          AND (copy_number = 1 OR o_orderstatus = 'F')""",
    "teams": """
        SELECT n_name AS TeamName, n_regionkey AS Tier,
               CASE WHEN n_regionkey % 2 = 0 THEN ' Northern ' ELSE 'southern' END AS Hemisphere
        FROM nation WHERE n_nationkey NOT IN (3, 17)""",
    "venues": """
        SELECT s_name AS VenueName, 'City of ' || s_name AS City, n_name AS Country, s_acctbal > 0 AS IsActive
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "team_keys": "SELECT upper(trim(TeamName)) AS team, Tier, upper(trim(Hemisphere)) AS Hemisphere FROM teams",
    "venue_keys": "SELECT upper(trim(VenueName)) AS venue_key, City, Country FROM venues WHERE IsActive",
    "ledger": """
        SELECT event_id AS id, user_id AS batch_id, event_id // 4 AS system_event_id,
               'provider_' || (user_id % 5) AS integration_provider,
               CASE WHEN user_id % 2 = 0 THEN 'results' ELSE 'fixtures' END AS integration_type,
               CASE event_type WHEN 'purchase' THEN 'ingested' WHEN 'signup' THEN 'preprocessed'
                    WHEN 'view' THEN 'preprocessing' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' END AS status,
               ts AS created_at, CAST(value AS VARCHAR) AS error_message
        FROM events""",
    "mappings": """
        SELECT 'provider_' || n_regionkey AS source_provider,
               CASE WHEN n_nationkey % 2 = 0 THEN 'results' ELSE 'fixtures' END AS source_type,
               'target_' || n_name AS target_table, 'job_' || (n_nationkey % 9) AS pipeline_name,
               CAST(n_nationkey % 3 AS BIGINT) AS execution_order
        FROM nation""",
    "scores": """
        SELECT ID, MatchDate, CompetitionName, HomeTeam, AwayTeam,
               1 / (1 + exp(-(HomeScore - 25) / 10)) AS home_win, CAST(HomeScore - 25 AS DOUBLE) AS point_diff,
               HomeScore - AwayScore AS PointDiff, CAST(HomeScore > AwayScore AS INTEGER) AS HomeWin,
               1.0 + ID % 7 AS weight, MatchDate AS ScoredAtUtc
        FROM matches""",
    "loose": r"""
        SELECT c_custkey,
               CASE WHEN c_custkey % 40 = 0 THEN ' ' ELSE CAST(c_acctbal AS VARCHAR) END AS account,
               CASE WHEN c_custkey % 2 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS half_numeric,
               c_mktsegment AS segment,
               CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END AS name
        FROM customer""",
}


def _sql(body: str, *names: str) -> str:
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in names) + "\n" + body


_ALLOWED = "('Rugby Championship', 'Internationals', 'Six Nations', 'Rugby World Cup', 'Pacific Nations Cup', 'Rugby Europe Championship')"
_LEAGUE = "('United Rugby Championship')"


def _clean(competitions: str, with_scores: bool, international: bool) -> str:
    needed = "match_date IS NOT NULL AND " + (
        "home_score IS NOT NULL AND away_score IS NOT NULL" if with_scores else "kickoff_time_local IS NOT NULL"
    )
    kickoff = "" if with_scores else f"{_KICKOFF} AS KickoffTimeLocal, "
    scores = "home_score AS HomeScore, away_score AS AwayScore, " if with_scores else ""
    flags = (
        """, Country IS NOT NULL AND upper(Country) <> upper(home_team) AND upper(Country) <> upper(away_team) AS Neutral,
           contains(lower(competition_name), 'world cup') AS WorldCup"""
        if international
        else ""
    )
    return f"""
        SELECT {kickoff}match_date AS MatchDate, upper(home_team) AS HomeTeam, upper(away_team) AS AwayTeam, {scores}
               upper(competition_name) AS CompetitionName, upper(venue) AS Venue, upper(City) AS City,
               upper(Country) AS Country{flags}
        FROM (SELECT DISTINCT * FROM scraped WHERE competition_name IN {competitions} AND {needed})
        LEFT JOIN venue_keys ON upper(trim(venue)) = venue_key"""


_KICKOFF = r"""strftime(try_strptime(match_date || ' ' || CASE WHEN regexp_matches(kickoff_time_local, '^\d+:\d+[AaPp][Mm]$')
    THEN upper(kickoff_time_local) END, '%Y-%m-%d %I:%M%p'), '%Y-%m-%d %H:%M:%S')"""

_SIDES = """
    SELECT *, PointsFor - PointsAgainst AS PointDiff,
           CAST(PointsFor > PointsAgainst AS BIGINT) AS Win, CAST(PointsFor = PointsAgainst AS BIGINT) AS Draw,
           CAST(PointsFor < PointsAgainst AS BIGINT) AS Loss
    FROM (SELECT {columns}, HomeTeam AS Team, AwayTeam AS Opponent, HomeScore AS PointsFor,
                 AwayScore AS PointsAgainst, 1 AS IsHome FROM {source}
          UNION ALL
          SELECT {columns}, AwayTeam, HomeTeam, AwayScore, HomeScore, 0 FROM {source})"""

_FORM = """
    SELECT *, avg(Win) OVER w AS FormWinRate, avg(Draw) OVER w AS FormDrawRate, avg(PointsFor) OVER w AS FormPointsFor,
           avg(PointsAgainst) OVER w AS FormPointsAgainst, avg(PointDiff) OVER w AS FormPointDiff,
           CAST(sum(CASE WHEN PointsFor IS NOT NULL AND PointsAgainst IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS FormGames
    FROM ({sides})
    WINDOW w AS (PARTITION BY Team ORDER BY {order} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""

_FORM_COLUMNS = ("FormWinRate", "FormDrawRate", "FormPointsFor", "FormPointsAgainst", "FormPointDiff", "FormGames")
_DIFFERENCES = ("FormWinRate", "FormPointDiff", "FormPointsFor", "FormPointsAgainst")
_ATTACHED = ",\n".join(
    [f"h.{c} AS Home_{c}" for c in _FORM_COLUMNS]
    + [f"a.{c} AS Away_{c}" for c in _FORM_COLUMNS]
    + [f"h.{c} - a.{c} AS Diff_{c}" for c in _DIFFERENCES]
)
_BOTH = """
    SELECT ID, 'fixture' AS origin, MatchDate, KickoffTimeLocal, HomeTeam, AwayTeam, NULL::BIGINT AS HomeScore,
           NULL::BIGINT AS AwayScore, CompetitionName, Venue FROM fixtures
    UNION ALL
    SELECT ID, 'result', MatchDate, NULL, HomeTeam, AwayTeam, HomeScore, AwayScore, CompetitionName, Venue FROM results"""


def _known(source: str) -> str:
    return f"""
        SELECT m.* FROM {source} m
        WHERE upper(HomeTeam) IN (SELECT team FROM team_keys) AND upper(AwayTeam) IN (SELECT team FROM team_keys)
          AND upper(Venue) IN (SELECT upper(trim(VenueName)) FROM venues)"""


def _attributes(with_tier: bool) -> str:
    tier = """CAST(ht.Tier AS BIGINT) AS Home_Tier, CAST(aw.Tier AS BIGINT) AS Away_Tier,
                  CAST(ht.Tier - aw.Tier AS BIGINT) AS Diff_Tier,""" if with_tier else ""
    return f"{tier} ht.Hemisphere AS Home_Hemisphere, aw.Hemisphere AS Away_Hemisphere,"


def _model_results(with_tier: bool, half_life: float) -> str:
    sides = _SIDES.format(columns="ID, MatchDate", source="known")
    return f"""{_sql("", "matches", "teams", "venues", "team_keys").rstrip()},
        known AS ({_known("matches")}),
        form AS ({_FORM.format(sides=sides, order="MatchDate, ID")})
        SELECT m.ID, strftime(m.MatchDate, '%Y-%m-%d') AS MatchDate, m.HomeTeam, m.AwayTeam, m.CompetitionName, m.Venue,
               {_attributes(with_tier)} {_ATTACHED},
               round(pow(0.5, date_diff('day', m.MatchDate, (SELECT max(MatchDate) FROM known)) / 365.25 / {half_life}), 9)
                   AS TimeDecayWeight,
               m.HomeScore - m.AwayScore AS PointDiff, CAST(m.HomeScore > m.AwayScore AS INTEGER) AS HomeWin
        FROM known m
        LEFT JOIN form h ON h.ID = m.ID AND h.Team = m.HomeTeam AND h.IsHome = 1
        LEFT JOIN form a ON a.ID = m.ID AND a.Team = m.AwayTeam AND a.IsHome = 0
        LEFT JOIN team_keys ht ON upper(m.HomeTeam) = ht.team
        LEFT JOIN team_keys aw ON upper(m.AwayTeam) = aw.team
        WHERE m.HomeScore <> m.AwayScore"""


def _model_fixtures(with_tier: bool, half_life: float) -> str:
    sides = _SIDES.format(columns="ID, origin, MatchDate, KickoffTimeLocal", source="known")
    order = "MatchDate, ID, coalesce(KickoffTimeLocal, MatchDate)"
    return f"""{_sql("", "matches", "results", "fixtures", "teams", "venues", "team_keys").rstrip()},
        both_kinds AS ({_BOTH}),
        known AS ({_known("both_kinds")}),
        form AS ({_FORM.format(sides=sides, order=order)})
        SELECT m.ID, strftime(m.MatchDate, '%Y-%m-%d') AS MatchDate, m.HomeTeam, m.AwayTeam, m.CompetitionName, m.Venue,
               strftime(m.KickoffTimeLocal, '%Y-%m-%d %H:%M:%S') AS KickoffTimeLocal,
               {_attributes(with_tier)} {_ATTACHED},
               round(pow(0.5, date_diff('day', m.MatchDate, (SELECT max(MatchDate) FROM known)) / 365.25 / {half_life}), 9)
                   AS TimeDecayWeight
        FROM known m
        LEFT JOIN form h ON h.ID = m.ID AND h.origin = m.origin AND h.Team = m.HomeTeam AND h.IsHome = 1
        LEFT JOIN form a ON a.ID = m.ID AND a.origin = m.origin AND a.Team = m.AwayTeam AND a.IsHome = 0
        LEFT JOIN team_keys ht ON upper(m.HomeTeam) = ht.team
        LEFT JOIN team_keys aw ON upper(m.AwayTeam) = aw.team
        WHERE m.KickoffTimeLocal IS NOT NULL"""


_RANGES = """
    SELECT integration_provider, integration_type,
           coalesce(CAST(max(created_at) FILTER (WHERE status IN ('ingested', 'preprocessed', 'preprocessing')) AS DATE),
                    DATE '2024-01-01') AS first_day,
           DATE '2024-03-15' AS last_day
    FROM ledger GROUP BY 1, 2"""

_PREDICTIONS = """
    SELECT CASE WHEN CompetitionName = 'UNITED RUGBY CHAMPIONSHIP' THEN 'LeagueScores' ELSE 'InternationalScores' END AS table_name,
           CompetitionName AS competition, HomeTeam AS home_team, AwayTeam AS away_team,
           round(home_win, 9) AS home_team_win_prob, point_diff,
           CASE WHEN home_win >= 0.5 THEN HomeTeam ELSE AwayTeam END AS predicted_winner,
           CASE WHEN home_win IS NOT NULL THEN printf('%.1f%%', home_win * 100) END AS home_team_win_prob_pct,
           CASE WHEN point_diff IS NOT NULL THEN printf('%.1f pts', abs(point_diff)) END AS predicted_margin
    FROM (SELECT * REPLACE (CASE WHEN ID % 4 > 0 THEN home_win END AS home_win,
                            CASE WHEN ID % 4 > 0 THEN point_diff END AS point_diff) FROM scores)
    WHERE ScoredAtUtc >= TIMESTAMP '1998-06-01' AND ScoredAtUtc < TIMESTAMP '1998-06-02'"""


def _url(key: str) -> str:
    return rf"nullif(regexp_extract(url, '^[^?#]*\?(?:[^#]*?&)?{key}=([^&#]+)', 1), '') AS {key}"


def _profile_line(name: str, kind: str) -> str:
    return f"""SELECT '{name}' AS column_name, count(*) AS rows, count({name}) AS non_null,
                      count(TRY_CAST(trim({name}) AS DOUBLE)) AS "numeric", '{kind}' AS kind FROM loose"""


_HISTORICAL = """SELECT match_date AS MatchDate, upper(home_team) AS HomeTeam, upper(away_team) AS AwayTeam,
                  home_score AS HomeScore, away_score AS AwayScore, upper(competition_name) AS CompetitionName,
                  upper(venue) AS Venue, upper(home_team) AS City, upper(away_team) AS Country,
                  state IS NOT DISTINCT FROM 'FT' AS Neutral, contains(competition_name, 'World Cup') AS WorldCup
           FROM (SELECT DISTINCT match_date, home_team, away_team, home_score, away_score, competition_name, venue,
                                 state IS NOT DISTINCT FROM 'FT' AS finished, CASE WHEN state = 'FT' THEN 'FT' END AS state
                 FROM scraped)
           WHERE match_date IS NOT NULL AND home_score IS NOT NULL AND away_score IS NOT NULL"""

ORACLE = {
    "table_scan_filter": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_totalprice > 250000.0 AND o_orderpriority = '2-HIGH'""",
    "batch_scoped_scan": _sql('SELECT id, batch_id AS "Batch_ID", status FROM ledger WHERE batch_id = 42', "ledger"),
    "active_venues": _sql(
        "SELECT VenueName AS venue, City AS city, Country AS country FROM venues WHERE IsActive", "venues"
    ),
    "csv_snapshot": _sql(_clean(_LEAGUE, True, False), "scraped", "venues", "venue_keys"),
    "date_spine": """
        SELECT o_orderpriority, strftime(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)), '%Y-%m-%d') AS day
        FROM orders GROUP BY o_orderpriority""",
    "incremental_range": _sql(
        f"""SELECT integration_provider, integration_type, strftime(first_day, '%Y-%m-%d') AS first_day,
                   strftime(last_day, '%Y-%m-%d') AS last_day,
                   integration_provider || '_' || integration_type || '_' || strftime(first_day, '%Y-%m-%d') || '_to_'
                       || strftime(last_day, '%Y-%m-%d') AS dataset
            FROM ({_RANGES})""",
        "ledger",
    ),
    "fetch_days": _sql(
        f"""SELECT integration_provider, integration_type,
                   strftime(unnest(generate_series(CAST(first_day AS TIMESTAMP), CAST(last_day AS TIMESTAMP), INTERVAL 1 DAY)), '%Y-%m-%d') AS day
            FROM ({_RANGES})""",
        "ledger",
    ),
    "url_param": f"SELECT page_id, {_url('page')}, {_url('ref')} FROM pages",
    "extract_pages": _sql(
        """SELECT ID AS page_id, 'feed' AS provider, 'fixtures' AS integration_type,
                  strftime(MatchDate, '%Y-%m-%d') AS match_date, CAST(length(CompetitionName) AS VARCHAR) AS competition_id,
                  CompetitionName AS competition_name, HomeTeam AS home_team, AwayTeam AS away_team,
                  HomeScore AS home_score, AwayScore AS away_score, Venue AS venue, '8:00PM' AS kickoff_time_local,
                  '8:00pm' AS state, 'Round & ' || (ID % 9) AS round, NULL::VARCHAR AS live_note,
                  'https://example.org/match?x=1&g=' || ID AS match_link, CAST(ID AS VARCHAR) AS match_id
           FROM matches
           WHERE HomeScore <= AwayScore AND MatchDate IN (SELECT MatchDate FROM matches WHERE HomeScore > 25)""",
        "matches",
    ),
    "streamed_pages": _sql(
        """SELECT 'feed' AS provider, 'fixtures' AS integration_type,
                  strftime(MatchDate, '%Y-%m-%d') AS match_date, CAST(length(CompetitionName) AS VARCHAR) AS competition_id,
                  CompetitionName AS competition_name, HomeTeam AS home_team, AwayTeam AS away_team,
                  HomeScore AS home_score, AwayScore AS away_score, Venue AS venue, '8:00PM' AS kickoff_time_local,
                  '8:00pm' AS state, 'Round & ' || (ID % 9) AS round, NULL::VARCHAR AS live_note,
                  'https://example.org/match?x=1&g=' || ID AS match_link, CAST(ID AS VARCHAR) AS match_id
           FROM matches WHERE HomeScore <= AwayScore""",
        "matches",
    ),
    "requested_dates": _sql(
        """SELECT match_date, record, home_team FROM scraped
           WHERE CAST(match_date AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) - INTERVAL 25 YEAR FROM events)
                                              AND (SELECT CAST(max(ts) AS DATE) - INTERVAL 25 YEAR FROM events)""",
        "scraped",
    ),
    "completed_exclusion": _sql(
        """SELECT record, integration_type, state FROM scraped
           WHERE NOT (integration_type = 'fixtures' AND state IS NOT DISTINCT FROM 'FT')""",
        "scraped",
    ),
    "dedup_keep_first": _sql(
        """SELECT match_id, page_id, pos, record, home_team FROM scraped
           QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY page_id, pos, record) = 1""",
        "scraped",
    ),
    "allow_list": _sql(f"SELECT record, competition_name FROM scraped WHERE competition_name IN {_ALLOWED}", "scraped"),
    "distinct_rows": """
        SELECT md5(text) AS text_md5, lang, source, n_chars FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)""",
    "drop_nulls": _sql(
        """SELECT record, match_date, home_score, match_id FROM scraped
           WHERE match_date IS NOT NULL AND home_score IS NOT NULL AND match_id IS NOT NULL""",
        "scraped",
    ),
    "kickoff_ts": _sql(f"SELECT record, {_KICKOFF} AS kickoff FROM scraped", "scraped"),
    "midnight_dates": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') END AS day
        FROM events""",
    "name_keys": _sql(
        "SELECT record, upper(trim(home_team)) AS team_key, upper(trim(venue)) AS venue_key FROM scraped", "scraped"
    ),
    "blank_text": "SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_name END AS clean FROM part",
    "neutral_matches": _sql(
        """SELECT record, Country AS country, Country IS NOT NULL AND upper(Country) <> upper(home_team)
                  AND upper(Country) <> upper(away_team) AS neutral
           FROM scraped LEFT JOIN venue_keys ON upper(trim(venue)) = venue_key""",
        "scraped", "venues", "venue_keys",
    ),
    "contains_flag": _sql(
        "SELECT record, contains(lower(competition_name), 'world cup') AS world_cup FROM scraped", "scraped"
    ),
    "geo_lookup": _sql(
        """SELECT record, venue, City AS city, Country AS country
           FROM scraped LEFT JOIN venue_keys ON upper(trim(venue)) = venue_key""",
        "scraped", "venues", "venue_keys",
    ),
    "historical_results": _sql(_HISTORICAL, "scraped"),
    "rerun_job": _sql(
        f"""SELECT count(*) AS rows, count(*) AS ids, count(*) AS last_id, CAST(sum(HomeScore) AS BIGINT) AS home_points,
                  CAST(sum(AwayScore) AS BIGINT) AS away_points, count(*) FILTER (Neutral) AS neutral
           FROM ({_HISTORICAL})""",
        "scraped",
    ),
    "international_results": _sql(_clean(_ALLOWED, True, True), "scraped", "venues", "venue_keys"),
    "league_results": _sql(_clean(_LEAGUE, True, False), "scraped", "venues", "venue_keys"),
    "international_fixtures": _sql(_clean(_ALLOWED, False, True), "scraped", "venues", "venue_keys"),
    "league_fixtures": _sql(_clean(_LEAGUE, False, False), "scraped", "venues", "venue_keys"),
    "team_filter": _sql(
        """SELECT ID, HomeTeam, AwayTeam FROM matches
           WHERE HomeTeam IN (SELECT team FROM team_keys) AND AwayTeam IN (SELECT team FROM team_keys)""",
        "matches", "teams", "team_keys",
    ),
    "venue_filter": _sql(
        "SELECT ID, Venue FROM matches WHERE upper(Venue) IN (SELECT upper(trim(VenueName)) FROM venues)",
        "matches", "venues",
    ),
    "rejected_names": _sql(
        """SELECT DISTINCT upper(team) AS rejected FROM (SELECT home_team AS team FROM scraped UNION ALL SELECT away_team FROM scraped)
           WHERE upper(team) NOT IN (SELECT team FROM team_keys)""",
        "scraped", "teams", "team_keys",
    ),
    "team_attrs": _sql(
        """SELECT ID, HomeTeam, AwayTeam, CAST(h.Tier AS BIGINT) AS Home_Tier, CAST(a.Tier AS BIGINT) AS Away_Tier,
                  CAST(h.Tier - a.Tier AS BIGINT) AS Diff_Tier, h.Hemisphere AS Home_Hemisphere, a.Hemisphere AS Away_Hemisphere
           FROM matches LEFT JOIN team_keys h ON HomeTeam = h.team LEFT JOIN team_keys a ON AwayTeam = a.team""",
        "matches", "teams", "team_keys",
    ),
    "league_attrs": _sql(
        """SELECT ID, h.Hemisphere AS Home_Hemisphere, a.Hemisphere AS Away_Hemisphere
           FROM matches LEFT JOIN team_keys h ON HomeTeam = h.team LEFT JOIN team_keys a ON AwayTeam = a.team""",
        "matches", "teams", "team_keys",
    ),
    "union_fixtures": _sql(
        f"""SELECT ID, origin, strftime(KickoffTimeLocal, '%Y-%m-%d %H:%M:%S') AS KickoffTimeLocal, HomeScore, AwayScore
            FROM ({_BOTH})""",
        "matches", "results", "fixtures",
    ),
    "long_format": _sql(
        f"""SELECT * REPLACE (strftime(MatchDate, '%Y-%m-%d') AS MatchDate)
            FROM ({_SIDES.format(columns="ID, MatchDate, CompetitionName", source=f"({_BOTH})")})""",
        "matches", "results", "fixtures",
    ),
    "lagged_windows": """
        SELECT event_id, avg(amount) OVER w AS mean_3, CAST(sum(amount) OVER w AS BIGINT) AS sum_3
        FROM (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS amount FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "rolling_form": _sql(
        "SELECT ID, Team, IsHome, " + ", ".join(_FORM_COLUMNS) + " FROM ("
        + _FORM.format(
            sides=_SIDES.format(columns="ID, MatchDate, KickoffTimeLocal", source=f"({_BOTH})"),
            order="MatchDate, ID, coalesce(KickoffTimeLocal, MatchDate)",
        )
        + ")",
        "matches", "results", "fixtures",
    ),
    "form_increment": _sql(
        "SELECT ID, Team, IsHome, " + ", ".join(_FORM_COLUMNS) + ", false AS Restated FROM ("
        + _FORM.format(sides=_SIDES.format(columns="ID, MatchDate", source="matches"), order="MatchDate, ID")
        + ") WHERE MatchDate >= DATE '2001-01-01'",
        "matches",
    ),
    "attach_form": f"""{_sql("", "matches").rstrip()},
        form AS ({_FORM.format(sides=_SIDES.format(columns="ID, MatchDate", source="matches"), order="MatchDate, ID")})
        SELECT m.ID, m.HomeTeam, m.AwayTeam, m.HomeScore, m.AwayScore, {_ATTACHED}
        FROM matches m
        LEFT JOIN form h ON h.ID = m.ID AND h.Team = m.HomeTeam AND h.IsHome = 1
        LEFT JOIN form a ON a.ID = m.ID AND a.Team = m.AwayTeam AND a.IsHome = 0""",
    "targets": _sql(
        """SELECT ID, HomeScore - AwayScore AS PointDiff, CAST(HomeScore > AwayScore AS INTEGER) AS HomeWin
           FROM matches WHERE HomeScore <> AwayScore""",
        "matches",
    ),
    "time_decay": _sql(
        """SELECT ID, round(pow(0.5, date_diff('day', MatchDate, (SELECT max(MatchDate) FROM matches)) / 365.25 / 5.0), 9) AS weight
           FROM matches""",
        "matches",
    ),
    "results_model_ready": _model_results(True, 10.0),
    "league_model_ready": _model_results(False, 5.0),
    "fixtures_model_ready": _model_fixtures(True, 10.0),
    "fixtures_increment": _model_fixtures(True, 10.0),
    "league_fixtures_model_ready": _model_fixtures(False, 5.0),
    "schema_catalog": """
        SELECT p_partkey AS table_id, p_name AS table_name, p_type AS integration_type, p_brand AS integration_provider,
               'col_' || l_orderkey AS column_name, CASE WHEN l_returnflag = 'A' THEN 'int' ELSE 'string' END AS data_type,
               l_linestatus = 'F' AS is_required, CAST(l_linenumber AS BIGINT) AS ordinal_position
        FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_type = 'LARGE' AND p_brand = 'Brand#17'""",
    "schema_hash": """
        SELECT l_orderkey, l_linenumber,
               sha256(array_to_string(list_sort(['l_partkey_' || l_partkey, 'l_suppkey_' || l_suppkey,
                                                 'l_returnflag_' || l_returnflag]), '|')) AS schema_hash
        FROM lineitem""",
    "type_check": """
        WITH judged AS (SELECT * FROM orders LEFT JOIN labels ON o_orderkey = doc_id)
        SELECT 'o_orderkey' AS column_name, 'int' AS data_type, true AS is_required, true AS is_present, true AS type_ok,
               count(*) - count(o_orderkey) AS nulls, CAST(0 AS BIGINT) AS outside_zero_one FROM judged
        UNION ALL SELECT 'o_totalprice', 'decimal', true, true, true, count(*) - count(o_totalprice), 0 FROM judged
        UNION ALL SELECT 'o_orderdate', 'date', false, true, true, count(*) - count(o_orderdate), 0 FROM judged
        UNION ALL SELECT 'o_orderpriority', 'int', false, true, false, count(*) - count(o_orderpriority), 0 FROM judged
        UNION ALL SELECT 'quality', 'bit', false, true, true, count(*) - count(quality), count(*) FILTER (WHERE quality NOT IN (0, 1)) FROM judged
        UNION ALL SELECT 'o_custkey', 'bool', false, true, true, count(*) - count(o_custkey), count(*) FILTER (WHERE o_custkey NOT IN (0, 1)) FROM judged
        UNION ALL SELECT 'o_orderstatus', 'unheard of', false, true, false, count(*) - count(o_orderstatus), 0 FROM judged
        UNION ALL SELECT 'absent', 'string', true, false, false, count(*), 0 FROM judged""",
    "profile_columns": _sql(
        " UNION ALL ".join(
            _profile_line(name, kind)
            for name, kind in {"account": "number", "half_numeric": "text", "segment": "category", "name": "text"}.items()
        ),
        "loose",
    ),
    "normalise_types": _sql(
        """SELECT c_custkey, TRY_CAST(trim(account) AS DOUBLE) AS account, half_numeric, segment, nullif(trim(name), '') AS name
           FROM loose""",
        "loose",
    ),
    "status_filter": _sql("SELECT id, batch_id, status FROM ledger WHERE status = 'ingested'", "ledger"),
    "plan_expansion": _sql(
        """SELECT system_event_id, batch_id, target_table, pipeline_name, execution_order
           FROM ledger JOIN mappings ON integration_provider = source_provider AND integration_type = source_type
           WHERE status = 'ingested'""",
        "ledger", "mappings",
    ),
    "plan_persist": _sql(
        """SELECT batch_id, pipeline_name, 'started' AS status, true AS has_id
           FROM ledger JOIN mappings ON integration_provider = source_provider AND integration_type = source_type
           WHERE ledger.status = 'ingested'""",
        "ledger", "mappings",
    ),
    "high_water": _sql(
        """SELECT integration_provider, integration_type, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS high_water
           FROM ledger WHERE status IN ('ingested', 'preprocessed', 'preprocessing') GROUP BY 1, 2""",
        "ledger",
    ),
    "latest_version": _sql(
        """SELECT batch_id AS model_key, status AS trainer_key, id AS version, error_message FROM ledger
           QUALIFY row_number() OVER (PARTITION BY batch_id, status ORDER BY id DESC) = 1""",
        "ledger",
    ),
    "next_version": """
        SELECT p_partkey AS l_partkey, CAST(coalesce(max(l_linenumber), 0) + 1 AS BIGINT) AS next_version
        FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""",
    "batch_rollup": """
        SELECT batch_id, CASE WHEN all_done THEN 'preprocessed' ELSE 'failed to preprocess' END AS batch_status,
               CASE WHEN NOT all_done THEN 'Preprocessing failed for some preprocessing events for this batch' END AS error_message
        FROM (SELECT batch_id, coalesce(bool_and(event_type <> 'error'), true) AS all_done
              FROM (SELECT DISTINCT event_id // 2 AS batch_id FROM events)
              LEFT JOIN events ON event_id // 4 = batch_id GROUP BY batch_id)""",
    "ledger_state": _sql(
        """SELECT batch_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "at", status, error_message FROM ledger
           QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, id DESC) = 1""",
        "ledger",
    ),
    "time_split": _sql(
        """SELECT ID, row_number() OVER (ORDER BY MatchDate, ID)
                  > greatest(1, count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.2))) AS is_validation
           FROM matches""",
        "matches",
    ),
    "binary_metrics": _sql(
        """SELECT round(sum(CASE WHEN (home_win >= 0.5) = (HomeWin = 1) THEN weight ELSE 0 END) / sum(weight), 9) AS accuracy,
                  round(2 * sum(CASE WHEN home_win >= 0.5 AND HomeWin = 1 THEN weight ELSE 0 END)
                        / (2 * sum(CASE WHEN home_win >= 0.5 AND HomeWin = 1 THEN weight ELSE 0 END)
                           + sum(CASE WHEN (home_win >= 0.5) <> (HomeWin = 1) THEN weight ELSE 0 END)), 9) AS f1,
                  round(-sum(weight * ln(CASE WHEN HomeWin = 1 THEN home_win ELSE 1 - home_win END)) / sum(weight), 9) AS logloss
           FROM (SELECT * REPLACE (CAST(weight AS DOUBLE) AS weight) FROM scores)""",
        "matches", "scores",
    ),
    "auc": _sql(
        """SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc
           FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY home_win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
                 FROM (SELECT home_win, CAST(sum(CASE WHEN HomeWin = 1 THEN weight ELSE 0 END) AS DOUBLE) AS pos,
                              CAST(sum(CASE WHEN HomeWin = 0 THEN weight ELSE 0 END) AS DOUBLE) AS neg
                       FROM scores GROUP BY home_win))""",
        "matches", "scores",
    ),
    "regression_metrics": _sql(
        """SELECT round(sqrt(sum(w * e * e) / sum(w)), 9) AS rmse, round(sum(w * abs(e)) / sum(w), 9) AS mae,
                  round(1 - sum(w * e * e) / sum(w * (y - mean) * (y - mean)), 9) AS r2
           FROM (SELECT CAST(weight AS DOUBLE) AS w, CAST(PointDiff AS DOUBLE) AS y, PointDiff - point_diff AS e,
                        (SELECT CAST(sum(weight * PointDiff) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) FROM scores) AS mean
                 FROM scores)""",
        "matches", "scores",
    ),
    "model_metrics": _sql(
        """SELECT model_key, CompetitionName, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1, round(logloss, 9) AS logloss, round(auc, 9) AS auc
           FROM (SELECT model_key, CompetitionName,
                        sum(w * CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER)) / sum(w) AS accuracy,
                        coalesce(2 * sum(w * y) FILTER (p >= 0.5) / (sum(w) FILTER (p >= 0.5) + sum(w * y)), 0) AS f1,
                        sum(-w * ln(CASE WHEN y = 1 THEN c ELSE 1 - c END)) / sum(w) AS logloss
                 FROM (SELECT *, greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p)) AS c FROM modelled) GROUP BY 1, 2)
           JOIN (SELECT model_key, CompetitionName, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc
                 FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model_key, CompetitionName ORDER BY p
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
                       FROM (SELECT model_key, CompetitionName, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM modelled GROUP BY 1, 2, 3))
                 GROUP BY 1, 2) USING (model_key, CompetitionName)""",
        "matches", "scores",
    ).replace("modelled", """(SELECT CompetitionName, CAST(weight AS DOUBLE) AS w, HomeWin AS y, model_key,
                        CASE model_key WHEN 'logistic' THEN home_win WHEN 'coarse' THEN round(home_win, 1) ELSE 1 - home_win END AS p
                 FROM scores, (VALUES ('logistic'), ('coarse'), ('contrary')) AS models(model_key))"""),
    "boosting_checks": _sql(
        """SELECT model_key, count(*) FILTER (model_key LIKE 'gaps%' OR (HomeScore - AwayScore >= -20 AND ID % 11 > 0)) AS train_rows,
                  true AS least_loss, true AS beats_constant, true AS beats_constant_on_gaps
           FROM matches, (VALUES ('complete HomeWin'), ('complete PointDiff'), ('gaps HomeWin'), ('gaps PointDiff')) AS models(model_key)
           GROUP BY 1""",
        "matches",
    ),
    "stored_models": _sql(
        """SELECT model_key, 2 AS version, false AS lacks_metrics, count(*) AS scored_rows, CAST(0 AS BIGINT) AS differing_rows
           FROM matches, (VALUES ('stored HomeWin'), ('stored PointDiff')) AS models(model_key) GROUP BY 1""",
        "matches",
    ),
    "wide_scores": _sql(
        "SELECT ID, HomeTeam, round(home_win, 9) AS homewin_v1, point_diff AS pointdiff_v1 FROM scores", "matches", "scores"
    ),
    "daily_predictions": _sql(_PREDICTIONS, "matches", "scores"),
    "partitioned_predictions": _sql(_PREDICTIONS, "matches", "scores"),
    "wide_category_checks": """
        SELECT model_key, count(*) AS train_rows, count(*) AS scored_rows, true AS beats_constant, CAST(0 AS BIGINT) AS differing_rows
        FROM lineitem, (VALUES ('by day'), ('by fold')) AS models(model_key) GROUP BY 1""",
    "digest": _sql(
        f"""SELECT table_name, competition, home_team, away_team, predicted_winner, home_team_win_prob_pct, predicted_margin
            FROM ({_PREDICTIONS})""",
        "matches", "scores",
    ),
    "digest_sections": _sql(f"SELECT table_name, count(*) AS rows FROM ({_PREDICTIONS}) GROUP BY 1", "matches", "scores"),
    "typed_snapshot": """
        SELECT o_orderkey AS order_id, o_custkey % 2 = 1 AS odd, o_custkey AS customer, o_totalprice AS price,
               strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 7 > 0 THEN o_orderpriority END AS priority
        FROM orders""",
    "rejected_values": """
        SELECT 'odd' AS column_name, 'bit' AS data_type, count(*) FILTER (o_custkey % 3 = 2) AS rejected,
               min('2') FILTER (o_custkey % 3 = 2) AS example FROM orders
        UNION ALL SELECT 'customer', 'int', count(*) FILTER (o_custkey % 5 = 0),
               min('no ' || o_custkey) FILTER (o_custkey % 5 = 0) FROM orders
        UNION ALL SELECT 'day', 'date', count(*) FILTER (o_orderkey % 9 = 0), min('2001-02-30') FILTER (o_orderkey % 9 = 0) FROM orders
        UNION ALL SELECT 'priority', 'string', 0, NULL FROM orders WHERE false OR o_orderkey = (SELECT min(o_orderkey) FROM orders)""",
    "published_table": """
        SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) AS stamped,
               CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, count(*) AS ids
        FROM orders""",
    "appended_table": """
        SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) AS stamped,
               CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, count(*) AS ids
        FROM orders""",
    "replaced_table": "SELECT o_orderkey AS ID, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1",
    "job_results_to_model": _model_results(True, 10.0),
    "attach_form_gaps": f"""{_sql("", "matches").rstrip()},
        gaps AS (SELECT * REPLACE (CASE WHEN ID % 11 > 0 THEN HomeTeam END AS HomeTeam,
                                   CASE WHEN ID % 13 > 0 THEN AwayTeam END AS AwayTeam) FROM matches),
        form AS ({_FORM.format(sides=_SIDES.format(columns="ID, MatchDate", source="gaps"), order="MatchDate, ID")})
        SELECT m.ID, m.HomeTeam, m.AwayTeam, m.HomeScore, m.AwayScore, {_ATTACHED}
        FROM gaps m
        LEFT JOIN form h ON h.ID = m.ID AND h.Team = m.HomeTeam AND h.IsHome = 1
        LEFT JOIN form a ON a.ID = m.ID AND a.Team = m.AwayTeam AND a.IsHome = 0""",
    "stored_scores": _sql(
        """SELECT ID, round(home_win, 9) AS homewin_v1, point_diff AS pointdiff_v1, 'run 3' AS SystemEventId,
                  'international' AS ModelGroupKey, true AS stamped FROM scores""",
        "matches", "scores",
    ),
    "training_rows": _sql(
        """SELECT ID, row_number() OVER (ORDER BY MatchDate, ID)
                  > greatest(1, count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.25))) AS is_validation
           FROM matches WHERE ID % 7 > 0 AND ID % 5 > 0""",
        "matches",
    ),
    "train_score_checks": f"""SELECT ID, true AS is_probability, true AS is_finite, true AS scores_vary FROM ({_model_fixtures(True, 10.0)})""",
}
ORACLE["model_dataset"] = ORACLE["normalise_types"]
