"""The opponent and the season-prior experiments by hand."""

import pytest
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.plans import opponent, season_prior

MATCH = "season string, fixture_id long, gameweek_id int, home_team_id int, away_team_id int, home_goals int, away_goals int, home_xg double, away_xg double"


def contexts(spark):
    # Team 1 concedes 4, 4, 4; team 2 concedes 0 three times; team 3 has two matches only.
    games = [("s", 1, 1, 1, 2, 0, 4, 0.5, 2.0), ("s", 2, 2, 2, 1, 4, 0, 2.0, 0.5), ("s", 3, 3, 1, 3, 1, 4, 1.0, 2.0), ("s", 4, 4, 2, 3, 1, 0, 1.0, 0.5), ("s", 5, 9, 1, 2, 9, 9, 9.0, 9.0)]
    targets = spark.createDataFrame([("s", 5), ("s", 4)], "season string, target_gameweek int")
    return opponent.opponent_contexts(spark.createDataFrame(games, MATCH), targets)


def test_opponent_factors(spark):
    by = {(r.target_gameweek, r.team): r for r in contexts(spark).collect()}
    one, two, three = by[5, 1], by[5, 2], by[5, 3]
    league = (0 + 4 + 0 + 4 + 1 + 4 + 1 + 0) / 8
    assert (one.matches, one.raw_factor_gc, one.factor_gc, one.neutral_reason) == (3, pytest.approx(4 / league), 1.3, None)
    assert (two.raw_factor_gc, two.factor_gc) == (0.0, 0.7)
    assert (three.matches, three.factor_gc, three.factor_xgc, three.neutral_reason) == (2, 1.0, 1.0, "fewer_than_3_prior_matches")
    assert by[4, 1].matches == 3 and (4, 3) in by and by[4, 3].matches == 1  # the later match isn't seen
    pair = opponent.factor_correlation(contexts(spark)).collect()[0]
    assert pair.pairs == 6 and pair.pearson == pytest.approx(pair.spearman, abs=0.3)


PREDICTION = "season string, target_gameweek int, player_id long, position string, fixture_id long, target_has_fixture boolean, target_fixture_count long, opponent_team_id int, expected_minutes double, appearance_points double, goal_points double, assist_points double"


def test_candidates_by_fixture_and_period(spark):
    rows = [("s", 5, 1, "Forward", 10, True, 2, 1, 90.0, 2.0, 4.0, 1.0), ("s", 5, 1, "Forward", 11, True, 2, 2, 90.0, 2.0, 4.0, 1.0), ("s", 5, 2, "Forward", None, False, 0, None, 90.0, 2.0, 4.0, 1.0), ("s", 5, 3, "Forward", 12, True, 1, 99, 90.0, 2.0, 4.0, 1.0), ("s", 5, 4, "Forward", 13, True, 1, 1, 30.0, 1.0, None, 1.0)]
    fixtures = opponent.candidate_fixtures(spark.createDataFrame(rows, PREDICTION), contexts(spark))
    by = {(r.player_id, r.fixture_id, r.candidate): r for r in fixtures.collect()}
    assert len(by) == 15 and by[1, 10, "F0"].candidate_points == 7.0
    assert (by[1, 10, "F1"].candidate_goal, by[1, 10, "F1"].candidate_points) == (pytest.approx(5.2), pytest.approx(2 + 5 * 1.3))
    assert (by[2, None, "F1"].candidate_points, by[2, None, "F1"].candidate_complete) == (None, True)
    assert (by[3, 12, "F0"].candidate_points, by[3, 12, "F1"].candidate_points, by[3, 12, "F1"].candidate_complete) == (7.0, None, False)  # an opponent without matches
    assert (by[4, 13, "F1"].candidate_points, by[4, 13, "F1"].candidate_complete) == (pytest.approx(2.3), False)
    periods = {(r.player_id, r.candidate): r for r in opponent.candidate_periods(fixtures).collect()}
    assert (periods[1, "F1"].points, periods[1, "F1"].fixture_count, periods[1, "F1"].least_factor, periods[1, "F1"].rearrangement_risk) == (pytest.approx(4 + 5 * 1.3 + 5 * 0.7), 2, 0.7, True)
    assert (periods[2, "F2"].points, periods[2, "F2"].complete) == (0.0, True)
    assert (periods[4, "F0"].goal, periods[4, "F0"].attacking, periods[4, "F0"].points) == (None, None, 2.0)
    actuals = spark.createDataFrame([("s", 5, 3, 90, 6.0), ("s", 5, 4, 90, 1.0), ("s", 5, 1, 90, 1.0)], "season string, target_gameweek int, player_id long, minutes int, attacking double")
    assert opponent.primary_residuals(fixtures, actuals).count() == 0  # doubles, unknown factors and unknown goals are not primary
    known = spark.createDataFrame([("s", 5, 5, "Forward", 14, True, 1, 1, 90.0, 2.0, 4.0, 1.0)], PREDICTION)
    one = opponent.primary_residuals(opponent.candidate_fixtures(known, contexts(spark)), spark.createDataFrame([("s", 5, 5, 9, 6.0)], actuals.schema))
    assert {(r.candidate, r.residual, round(r.candidate_residual, 6)) for r in one.collect()} == {("F1", 1.0, -0.5), ("F2", 1.0, -0.5)}
    bands = opponent.factor_band_residuals(one).collect()
    assert len(bands) == 2 * len(X.FACTOR_BANDS) and {(r.candidate, r.band) for r in bands if r.n} == {("F1", "1.30"), ("F2", "1.30")}


PRIOR = "code long, identity_count long, exception_rows long, class string, minutes long, source_rows long, null_xg_rows long, nonfinite_xg_rows long, xg double, null_xa_rows long, nonfinite_xa_rows long, xa double"
GOOD = (1, 0, "MID", 900, 10, 0, 0, 4.0, 0, 0, 2.0)


def test_every_reason_in_order(spark):
    at = {"identity_count": 0, "exception_rows": 1, "class": 2, "minutes": 3, "source_rows": 4, "null_xg_rows": 5, "nonfinite_xg_rows": 6, "xg": 7, "null_xa_rows": 8, "nonfinite_xa_rows": 9, "xa": 10}
    change = lambda **c: tuple({i: v for k, v in c.items() for i in [at[k]]}.get(i, x) for i, x in enumerate(GOOD))
    cases = [
        ("previous_season_code_collision", change(identity_count=2, exception_rows=1)), ("previous_season_source_anomaly", change(exception_rows=1, **{"class": "XX"})), ("unknown_previous_season_position", change(**{"class": "XX"})), ("position_mismatch", change(**{"class": "DEF"}, minutes=None)),
        ("missing_previous_season_minutes", change(minutes=None)), ("zero_previous_season_minutes", change(minutes=0)), ("previous_season_minutes_below_450", change(minutes=449, source_rows=0)), ("missing_previous_season_performance", change(source_rows=0, null_xg_rows=1)),
        ("missing_previous_season_xg", change(null_xg_rows=1, nonfinite_xg_rows=1)), ("nonfinite_previous_season_xg", change(nonfinite_xg_rows=1, null_xa_rows=1)), ("missing_previous_season_xa", change(xa=None)), ("nonfinite_previous_season_xa", change(nonfinite_xa_rows=2)), ("eligible", change(minutes=450)),
    ]
    totals = spark.createDataFrame([(100 + i, *row) for i, (_, row) in enumerate(cases)], PRIOR)
    players = [(i, 100 + i, "MID", 1) for i in range(len(cases))] + [(50, None, "MID", 1), (51, 900, "MID", 1), (52, 900, "MID", 1), (53, 901, "MID", 2), (54, 902, "MID", 1)]
    got = {r.player_id: r.reason for r in season_prior.with_reasons(spark.createDataFrame(players, "player_id long, code long, class string, class_count long"), totals).collect()}
    want = {i: reason for i, (reason, _) in enumerate(cases)} | {50: "missing_target_code", 51: "target_code_collision", 52: "target_code_collision", 53: "target_position_anomaly", 54: "no_previous_season_code_match"}
    assert got == want and len(set(want.values())) == len(season_prior.REASONS) == 17


def test_blend_by_hand(spark):
    row = spark.createDataFrame([(2.0, 180.0, 9.0, 900.0), (0.0, 0.0, 9.0, 900.0)], "e double, m double, pe double, pm double")
    got = [r[0] for r in row.select(season_prior.blended_rate(F.col("e"), F.col("m"), F.col("pe"), F.col("pm"))).collect()]
    assert got == [pytest.approx(90 * (2 + 450 * 0.9 / 90) / 630), None]


def test_gates_fail_on_what_is_unknown(spark):
    specs = season_prior.gate_specs()
    assert len(specs) == 21 and len({g for _, g, *_ in specs}) == 21
    columns = ["c0_mae", "c0_rmse", "c0_bias", "c0_spearman", "c1_mae", "c1_rmse", "c1_bias", "c1_spearman", "mae_improvement", "rmse_improvement", "absolute_bias_increase", "spearman_change"]
    schema = "scope string, component string, pairs long, " + ", ".join(f"{c} double" for c in columns)
    good = (5.0, 6.0, 0.1, 0.50, 4.0, 5.0, -0.05, 0.53, 20.0, 16.0, -0.05, 0.03)
    rows = [(s, c, 9, *good) for s in season_prior.SCOPES for c in season_prior.COMPONENTS]
    covered = spark.createDataFrame([("C0", 90.0), ("C1", 89.5)], "candidate string, coverage_pct double")
    gates = season_prior.development_gates(spark.createDataFrame(rows, schema), covered)
    assert gates.where("not passed").count() == 0 and season_prior.decision(gates).first()[:] == (21, 21, True)
    assert {(r.c0, r.c1, r.change) for r in gates.where("gate like 'prediction_coverage%'").collect()} == {(90.0, 89.5, 0.5)}
    some = [r for r in rows if (r[0], r[1]) != ("GW2-5", "assist") and r[0] != "GW11+"]
    failed = {r.gate for r in season_prior.development_gates(spark.createDataFrame(some, schema), covered).where("not passed").collect()}
    assert {g for g in failed if not g.startswith("gw11_plus")} == {"best_goal_or_assist_spearman_improves_0_02", "other_component_spearman_declines_no_more_0_01"} and len(failed) == 8


def test_what_comes_later_changes_no_projection(spark):
    at = "player_id long, period int, minutes long, xg double, xa double, goals long, assists long"
    rows = [(1, p, 60, 0.3, 0.2, 1, 0) for p in range(1, 6)]
    player = season_prior.with_reasons(spark.createDataFrame([(1, 7, "MID", 1)], "player_id long, code long, class string, class_count long"), spark.createDataFrame([(7, *GOOD)], PRIOR))
    run = lambda extra: {r.period: (r.c0_modeled_xfp, r.c1_modeled_xfp) for r in season_prior.candidates(spark.createDataFrame(rows + extra, at), player).collect() if r.period < 6}
    plain = run([])
    assert plain == run([(1, 6, 90, 99.0, 99.0, 9, 9)]) and plain[1] == (None, None)
    own, lent = 0.3 * 90 / 60, 90 * (0.3 + 450 * 0.4 / 90) / 510
    assert plain[2][0] == pytest.approx(2 + own * 60 / 90 * 5 + 0.2 * 90 / 60 * 60 / 90 * 3) and plain[2][1] == pytest.approx(2 + lent * 60 / 90 * 5 + 90 * (0.2 + 450 * 0.2 / 90) / 510 * 60 / 90 * 3)


def test_candidates_of_the_season_prior_are_worked_out_once(spark):
    from panelyard import queries

    plan = queries.queries()["gate_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id" not in plan  # events are read while the candidates are written, never again
