import datetime as dt
import random
import re

import pytest
from tests.helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions.windows import lagged_mean, lagged_sum
from touchline.operators import form, ordering

MATCH = "ID bigint, MatchDate timestamp, HomeTeam string, AwayTeam string, HomeScore bigint, AwayScore bigint"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute_form(records, n=10):
    """Form by definition: for each team walk its rows in order, look at the previous n."""
    out = {}
    by_team = {}
    for r in records:
        by_team.setdefault(r["Team"], []).append(r)
    for team, own in by_team.items():
        own.sort(key=lambda r: (r["MatchDate"] is None, r["MatchDate"] or dt.datetime.max, r["ID"], -r["IsHome"]))
        for i, r in enumerate(own):
            past = own[max(0, i - n) : i]

            def mean(name):
                values = [p[name] for p in past if p[name] is not None]
                return sum(values) / len(values) if values else None

            played = sum(p["PointsFor"] is not None and p["PointsAgainst"] is not None for p in past)
            out[(r["ID"], team, r["IsHome"])] = (
                *(mean(c) for c in form.FORM_MEANS.values()),
                played if past else None,
            )
    return out


def league(seed, count, teams, days, unplayed=0.2, hot=0.4):
    """Random matches where one team takes part in a large share and one day holds many."""
    rng = random.Random(seed)
    made = []
    for i in range(count):
        home = "HOT" if rng.random() < hot else f"T{rng.randrange(teams)}"
        away = rng.choice([f"T{t}" for t in range(teams) if f"T{t}" != home])
        when = day(3 if rng.random() < 0.4 else rng.randrange(days))
        scores = (None, None) if rng.random() < unplayed else (rng.randrange(30), rng.randrange(30))
        made.append((i * 7 % 1009 + 1009 * (i // 1009), when, home, away, *scores))
    return made


def as_dict(df):
    return {(r["ID"], r["Team"], r["IsHome"]): tuple(r[c] for c in form.FORM_COLUMNS) for r in df.collect()}


def approximately(left, right):
    assert left.keys() == right.keys()
    for key in left:
        for a, b in zip(left[key], right[key]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (key, left[key], right[key])


def test_long_format(spark):
    df = spark.createDataFrame([(1, day(0), "A", "B", 10, 7), (2, day(1), "B", "A", None, None)], MATCH)
    long = form.to_team_rows(df.withColumn("Venue", F.lit("X")), context=["Venue", "Missing"])
    got = rows(long, "ID", "Team", "Opponent", "IsHome", "PointDiff", "Win", "Draw", "Loss", "Venue")
    assert got == [
        (1, "A", "B", 1, 3, 1, 0, 0, "X"),
        (1, "B", "A", 0, -3, 0, 0, 1, "X"),
        (2, "A", "B", 0, None, None, None, None, "X"),
        (2, "B", "A", 1, None, None, None, None, "X"),
    ]


def test_form_uses_earlier_rows_only(spark):
    df = spark.createDataFrame([(1, day(0), "A", "B", 10, 7), (2, day(1), "A", "C", 0, 50)], MATCH)
    got = as_dict(form.rolling_form(form.to_team_rows(df)))
    assert got[(1, "A", 1)] == (None, None, None, None, None, None)
    assert got[(2, "A", 1)] == (1.0, 0.0, 10.0, 7.0, 3.0, 1)


def test_unplayed_rows_take_a_slot(spark):
    played = [(i, day(i), "A", "B", 10, 0) for i in range(3)]
    open_rows = [(i, day(i), "A", "B", None, None) for i in range(3, 5)]
    df = spark.createDataFrame(played + open_rows, MATCH)
    got = as_dict(form.rolling_form(form.to_team_rows(df), window_rows=3))
    assert got[(4, "A", 1)] == (1.0, 0.0, 10.0, 0.0, 10.0, 2)


@pytest.mark.parametrize("pieces", [1, 3, 40, 400])
def test_form_matches_definition_in_any_number_of_pieces(spark, pieces):
    """A hot team and a hot day: the cut order must give the values of the definition exactly."""
    df = spark.createDataFrame(league(11, 600, 5, 60), MATCH)
    long = form.to_team_rows(df)
    expected = brute_form([r.asDict() for r in long.collect()])
    got = form.rolling_form(long, pieces=pieces)
    assert got.count() == 1200
    approximately(as_dict(got), expected)


def test_pieces_stay_small(spark):
    """No piece orders much more than its share: one hot group, text ids, one day and one stray time of day."""
    for stray in (0, 1):
        made = [(f"id{i * 7919 % 20000:05d}", day(1) + dt.timedelta(hours=int(stray and i == 5)), "A") for i in range(20000)]
        df = spark.createDataFrame(made, "ID string, at timestamp, team string")
        cut = ordering.in_pieces(df, [F.col("team"), F.col("at"), F.col("ID")], 20)
        assert cut.groupBy("_piece").count().agg(F.max("count")).first()[0] <= 3 * 1000
        ranked = ordering.global_rank(df, [F.col("at"), F.col("ID")], "rank", 20)
        order = [r["ID"] for r in ranked.orderBy("rank").collect()]
        assert order == [m[0] for m in sorted(made, key=lambda m: (m[1], m[0]))]


def test_form_with_times_within_a_day(spark):
    made = [(i, day(2) + dt.timedelta(minutes=(i * 37) % 1000), "A", f"B{i % 4}", i % 9, i % 5) for i in range(300)]
    df = spark.createDataFrame(made, MATCH)
    long = form.to_team_rows(df)
    approximately(as_dict(form.rolling_form(long, pieces=30)), as_dict(form.rolling_form(long, pieces=1)))


def test_null_dates_sort_last_and_null_teams_get_no_form(spark):
    made = [(1, None, "A", "B", 1, 0), (2, day(1), "A", "B", 5, 0), (3, day(2), None, "B", 5, 0), (4, day(3), None, "B", 5, 0), (5, day(4), "", "B", 5, 0)]
    df = spark.createDataFrame(made, MATCH)
    for pieces in (1, 8):
        got = as_dict(form.rolling_form(form.to_team_rows(df), pieces=pieces))
        assert got[(1, "A", 1)][2] == 5.0
        assert got[(4, None, 1)] == (None,) * 6
        assert got[(5, "", 1)] == (None,) * 6


def test_attach_with_one_unknown_side(spark):
    made = [(1, day(1), "A", "B", 5, 0), (2, day(2), None, "B", 5, 0), (3, day(3), "A", None, 5, 0)]
    df = spark.createDataFrame(made, MATCH)
    out = {r["ID"]: r for r in form.attach_form(df, form.rolling_form(form.to_team_rows(df))).collect()}
    assert len(out) == 3
    assert (out[2]["Home_FormGames"], out[2]["Away_FormGames"], out[2]["Away_FormWinRate"]) == (None, 1, 0.0)
    assert (out[3]["Home_FormWinRate"], out[3]["Away_FormGames"], out[3]["Diff_FormWinRate"]) == (1.0, None, None)


def test_attach_preserves_rows_and_subtracts(spark):
    df = spark.createDataFrame(league(3, 200, 6, 50), MATCH)
    form_rows = form.rolling_form(form.to_team_rows(df))
    out = form.attach_form(df, form_rows)
    assert out.count() == 200
    home = as_dict(form_rows)
    for r in out.collect():
        own, other = home[(r["ID"], r["HomeTeam"], 1)], home[(r["ID"], r["AwayTeam"], 0)]
        assert tuple(r[f"Home_{c}"] for c in form.FORM_COLUMNS) == own
        assert tuple(r[f"Away_{c}"] for c in form.FORM_COLUMNS) == other
        if own[0] is not None and other[0] is not None:
            assert r["Diff_FormWinRate"] == pytest.approx(own[0] - other[0])


def test_attach_of_given_form(spark):
    matches = spark.createDataFrame([(1, "A", "B")], "ID bigint, HomeTeam string, AwayTeam string")
    lines = [(1, "A", "B", 1, 0.6, 0.1, 20.0, 10.0, 10.0, 5), (1, "B", "A", 0, 0.4, 0.1, 14.0, 10.0, 4.0, 5)]
    given = spark.createDataFrame(
        lines,
        "ID bigint, Team string, Opponent string, IsHome int, FormWinRate double, FormDrawRate double, "
        "FormPointsFor double, FormPointsAgainst double, FormPointDiff double, FormGames bigint",
    )
    row = form.attach_form(matches, given).first()
    assert row["Diff_FormWinRate"] == pytest.approx(0.2) and row["Diff_FormPointDiff"] == pytest.approx(6.0)
    assert "Diff_FormDrawRate" not in row and "Diff_FormGames" not in row


def test_lagged_windows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, 5.0)], "i int, v double")
    w = Window.orderBy("i")
    got = rows(df.select("i", lagged_mean("v", w, 2), lagged_sum("v", w, 2)))
    assert got == [(1, None, None), (2, 1.0, 1.0), (3, 2.0, 4.0), (4, 3.0, 3.0)]


def test_targets(spark):
    df = spark.createDataFrame([(10, 7), (12, 12), (5, 9)], "HomeScore bigint, AwayScore bigint")
    assert rows(form.add_targets(df), "PointDiff", "HomeWin") == [(-4, 0), (3, 1)]
    assert form.add_targets(df, drop_draws=False).count() == 3


def test_time_decay(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2010-01-01",)], "MatchDate string")
    weights = {r["MatchDate"]: r["TimeDecayWeight"] for r in form.add_time_decay(df).collect()}
    assert weights["2020-01-01"] == 1.0
    assert weights["2010-01-01"] == pytest.approx(0.5 ** (3652 / 365.25 / 10))
    given = form.add_time_decay(df, reference=F.lit(dt.datetime(2030, 1, 1)), half_life_years=10.0)
    assert all(0 < r["TimeDecayWeight"] < 1 for r in given.collect())


def test_time_decay_rejects_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-01",), ("never",)], "MatchDate string")
    with pytest.raises(Exception, match="1 rows have invalid MatchDate values"):
        form.add_time_decay(df).collect()


@pytest.mark.parametrize("pieces", [1, 8, 80])
def test_global_rank(spark, pieces):
    rng = random.Random(2)
    made = [(i * 13 % 997, None if rng.random() < 0.1 else day(rng.randrange(5))) for i in range(400)]
    df = spark.createDataFrame(made, "ID bigint, at timestamp")
    ranked = ordering.global_rank(df, [F.col("at"), F.col("ID")], "rank", pieces)
    got = {r["ID"]: r["rank"] for r in ranked.collect()}
    expected = sorted(made, key=lambda r: (r[1] is None, r[1] or dt.datetime.max, r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(expected)}
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_form_is_one_window_without_python(spark):
    df = spark.createDataFrame(league(1, 50, 5, 20), MATCH)
    plan = form.rolling_form(form.to_team_rows(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan


def test_windows_read_the_pieces_where_they_are(spark):
    """The rows are shuffled once, by range, before they are written: no exchange is left in the plans."""
    df = spark.createDataFrame(league(1, 50, 5, 20), MATCH)
    for pieces in (1, 7):
        for out in (form.rolling_form(form.to_team_rows(df), pieces=pieces), ordering.global_rank(df, [F.col("MatchDate")], "rank", pieces)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Window" in plan and "Exchange hashpartitioning" not in plan and "Union" not in plan


@pytest.mark.parametrize("pieces", [1, 2, 13, 211])
def test_every_piece_has_a_bucket_of_its_own(spark, pieces):
    keys = ordering._bucket_keys(pieces)
    hashed = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(pieces))).collect()
    assert [r[0] for r in hashed] == list(range(pieces))


def test_last_rows_of_pieces_are_sorted_piece_by_piece(spark, monkeypatch):
    """What later pieces need is found by a task a piece: no plan lets one task run through all of them."""
    plans, add = [], ordering._Pieces.add
    monkeypatch.setattr(ordering._Pieces, "add", lambda self, rows: (plans.append(rows), add(self, rows))[1])
    at = dt.datetime(2020, 1, 1)
    df = spark.range(60).select(F.col("id").alias("ID"), F.lit(at).alias("MatchDate"), F.lit("A").alias("HomeTeam"), F.lit("B").alias("AwayTeam"),
                                F.col("id").alias("HomeScore"), F.lit(1).alias("AwayScore"))
    form.rolling_form(form.to_team_rows(df), pieces=6).collect()
    assert len(plans) == 2 and not any("Coalesce" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_more_rows_make_more_pieces(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("ID"), (F.col("id") % 3).alias("x"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ordering._pieces_for(df) == least
    monkeypatch.setattr(ordering, "ROWS_PER_PIECE", 20)
    wanted = least * -(-200 // (least * 20))
    assert ordering._pieces_for(df) == wanted and wanted * 20 >= 200
    ranked = ordering.global_rank(df, [F.col("x"), F.col("ID")], "rank")
    assert [r["ID"] for r in ranked.orderBy("rank").collect()] == sorted(range(200), key=lambda i: (i % 3, i))
    monkeypatch.setattr(ordering, "ROWS_PER_PIECE", 1)
    assert max(r["count"] for r in ordering.in_pieces(df, [F.col("ID")]).groupBy("_piece").count().collect()) <= 8


def test_more_rows_make_more_tasks_that_fold_and_join(spark, monkeypatch):
    """A task's share of the fold and of the join with the matches does not grow with the rows."""
    df = spark.createDataFrame(league(1, 200, 5, 20), MATCH)
    few = form.attach_form(df, form.rolling_form(form.to_team_rows(df)))
    monkeypatch.setattr(ordering, "ROWS_PER_PIECE", 50)
    many = form.attach_form(df, form.rolling_form(form.to_team_rows(df)))
    plan = many._jdf.queryExecution().executedPlan().toString()
    # Two sides of 200 matches in pieces of 50 rows; both inputs of the join are dealt alike.
    assert re.findall(r"hashpartitioning\(ID#\w+, (\d+)\)", plan) == ["8", "8"]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() == 200


def test_tasks_send_to_no_more_tasks_than_spark_serves_row_by_row(spark, monkeypatch):
    """Beyond 200 pieces a task would gather all rows it read before it sends them; then pieces grow instead."""
    df = spark.createDataFrame(league(5, 150, 5, 40), MATCH)
    long = form.to_team_rows(df)
    monkeypatch.setattr(ordering, "ROWS_PER_PIECE", 1)
    least = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for given, wanted in ((12, 192), (300, 300), (2, 200)):
            spark.conf.set("spark.sql.shuffle.partitions", given)
            assert ordering._pieces_for(long) == wanted
        form_rows = form.rolling_form(long)
        approximately(as_dict(form_rows), brute_form([r.asDict() for r in long.collect()]))
        plan = form.attach_form(df, form_rows)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"hashpartitioning\(ID#\w+, (\d+)\)", plan) == ["200", "200"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", least)
