import random
import re

import pytest
from pyspark.sql import functions as F
from tests.helpers import rows
from tests.test_form import MATCH, approximately, as_dict, brute_form, day, league

from touchline.operators import form, form_state, ordering


def team_rows(spark, made):
    return form.to_team_rows(spark.createDataFrame(made, MATCH))


def expected_of(long):
    return brute_form([r.asDict() for r in long.collect()])


def test_tail_is_bounded_and_counts(spark):
    made = league(5, 300, 4, 60)
    tail = form_state.form_tail(team_rows(spark, made), keep=12)
    held = {r["Team"]: r for r in tail.groupBy("Team").agg(F.count("*").alias("n"), F.max("Seen").alias("seen"), F.max("Newest").alias("newest")).collect()}
    for team, got in held.items():
        own = [m for m in made if team in m[2:4]]
        assert got["n"] == min(12, len(own)) and got["seen"] == len(own) and got["newest"] == max(m[1] for m in own)


@pytest.mark.parametrize("pieces", [1, 20])
def test_increment_equals_the_full_build(spark, pieces):
    made = sorted(league(7, 500, 5, 50), key=lambda m: (m[1], m[0]))
    whole = expected_of(team_rows(spark, made))
    tail = form_state.form_tail(team_rows(spark, made[:200]))
    tail = form_state.form_tail(team_rows(spark, made[200:400]), tail)
    new = team_rows(spark, made[400:])
    out = form_state.form_increment(tail, new, pieces=pieces)
    assert out.where("Restated").isEmpty() and out.count() == new.count()
    wanted = {m[0] for m in made[400:]}
    approximately(as_dict(out), {k: v for k, v in whole.items() if k[0] in wanted})


def test_merged_tail_is_the_tail_of_everything(spark):
    made = league(8, 300, 4, 40)
    random.Random(1).shuffle(made)
    parts = [team_rows(spark, made[i : i + 100]) for i in (0, 100, 200)]
    merged = None
    for part in parts:
        merged = form_state.form_tail(part, merged, keep=15)
    direct = form_state.form_tail(team_rows(spark, made), keep=15)
    assert rows(merged, *direct.columns) == rows(direct)


def test_late_rows_take_their_place_and_restate(spark):
    made = [(i, day(2 * i), "A", f"B{i}", i % 7, 3) for i in range(60)]
    late = [(1000, day(91), "A", "C", 50, 0)]
    whole = expected_of(team_rows(spark, made + late))
    before = expected_of(team_rows(spark, made))
    tail = form_state.form_tail(team_rows(spark, made), keep=40)
    out = form_state.form_increment(tail, team_rows(spark, late))
    got = as_dict(out)
    approximately(got, {k: whole[k] for k in got})
    changed = {k for k in before if before[k] != whole[k]}
    restated = {(r["ID"], r["Team"], r["IsHome"]) for r in out.where("Restated").collect()}
    assert changed <= restated and len(restated) == 10 and (1000, "A", 1) in got


def test_rows_beyond_the_tail_are_an_error(spark):
    made = [(i, day(i + 10), "A", f"B{i}", 1, 0) for i in range(60)]
    tail = form_state.form_tail(team_rows(spark, made), keep=20)
    for when in (day(55), day(1)):
        with pytest.raises(Exception, match="later than its tail can tell"):
            form_state.form_increment(tail, team_rows(spark, [(99, when, "A", "Z", 1, 0)])).collect()
    short = form_state.form_tail(team_rows(spark, made[:15]), keep=20)
    got = as_dict(form_state.form_increment(short, team_rows(spark, [(99, day(1), "A", "Z", 1, 0)])))
    assert got[(99, "A", 1)] == (None,) * 6 and got[(0, "A", 1)][-1] == 1


def test_null_teams_dates_and_empty_batches(spark):
    made = [(1, None, "A", "B", 1, 0), (2, day(1), "A", "B", 5, 0), (3, day(2), None, "B", 5, 0)]
    tail = form_state.form_tail(team_rows(spark, made))
    assert tail.where("Team is null").isEmpty() and tail.count() == 5
    nothing = team_rows(spark, [])
    assert form_state.form_increment(tail, nothing).isEmpty()
    assert rows(form_state.form_tail(nothing, tail), *tail.columns) == rows(tail)
    new = [(4, day(3), None, "B", 1, 1), (5, None, "A", None, 2, 2)]
    got = as_dict(form_state.form_increment(tail, team_rows(spark, new)).where("not Restated"))
    assert got[(4, None, 1)] == (None,) * 6 and got[(5, "A", 1)][2] == 3.0 and got[(4, "B", 0)][-1] == 2
    assert form_state.form_tail(nothing).isEmpty()


def test_state_runs_a_batch_again(spark, tmp_path):
    made = sorted(league(9, 240, 4, 60), key=lambda m: (m[1], m[0]))
    parts = [team_rows(spark, made[i : i + 80]) for i in (0, 80, 160)]
    whole = expected_of(team_rows(spark, made))
    state = form_state.FormState(spark, str(tmp_path / "state"))
    got = {}
    for number, part in enumerate(parts):
        first = as_dict(state.form(part, f"b{number}"))
        for _ in range(2):
            state.absorb(part, f"b{number}")
        assert as_dict(state.form(part, f"b{number}")) == first
        got.update(first)
    approximately(got, whole)
    with pytest.raises(ValueError, match="followed by others"):
        state.before("b0")
    total = state.before("next").groupBy("Team").agg(F.max("Seen").alias("n")).agg(F.sum("n")).first()[0]
    assert total == 480


def test_more_rows_make_more_tasks_that_keep_the_last_ones(spark, monkeypatch):
    """What a task sorts to hand on the last rows of each team does not grow with the rows."""
    long = team_rows(spark, league(9, 200, 4, 40))
    few = form_state.form_tail(long, keep=15)
    monkeypatch.setattr(ordering, "ROWS_PER_PIECE", 50)
    many = form_state.form_tail(long, keep=15)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(Team#\w+, MatchDate#.*, 8\), REPARTITION_BY_NUM", plan)
    assert rows(few) == rows(many)
