"""Feature rows and projections by hand: blanks, doubles, zero minutes, no history, gates, and what must not leak."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.plans import player_features as P

AT = dt.datetime(2024, 1, 14, 12)
PLAYERS = "season string, snapshot_timestamp string, player_id long, web_name string, position_id int, position string, team_id long, team_name string, status string, chance_of_playing_next_round int, news string"
FIXTURES = "season string, fixture_id long, gameweek_id int, home_team_id long, home_team_name string, away_team_id long, away_team_name string, kickoff_time timestamp_ntz"
HISTORY = "season string, player_id long, gameweek_id int, starts long, minutes long, total_points long, xg double, xa double, xgc double, defensive_contribution long, saves long"
CONTEXT = "season string, snapshot_timestamp string, target_gameweek int, target_deadline_time timestamp_ntz, availability_as_of timestamp_ntz, availability_reference_gameweek int, players_input_sha256 string, fixtures_input_sha256 string, history_input_sha256 string, bootstrap_sha256 string, fixture_retrieved_at timestamp_ntz, history_retrieved_at timestamp_ntz"
KINDS = list(P.POSITIONS)


@pytest.fixture(scope="module")
def tables(spark):
    player = lambda i, team, status="a", chance=None: ("s", "t", i, f"p{i}", i % 4 + 1, KINDS[i % 4], team, f"team{team}", status, chance, None)
    # 1 plays; 2 has a real zero; 3 has no history; 4 is blank; 5 is suspended; 6 has no chance; 7 is doubtful and has no rates.
    players = [player(1, 10), player(2, 10), player(3, 20), player(4, 90), player(5, 20, "s"), player(6, 30, "a", 0), player(7, 30, "d", 75)]
    game = lambda f, gw, home, away: ("s", f, gw, home, f"team{home}", away, f"team{away}", AT)
    fixtures = [game(100, 5, 10, 20), game(101, 5, 20, 30), game(102, 4, 10, 30), game(103, 6, 10, 90)]
    row = lambda i, gw, m, xg=0.5, xa=0.25: ("s", i, gw, int(m > 0), m, m // 30, xg, xa, 1.0, 2, None)
    history = [row(1, 1, 90), row(1, 2, 45), row(1, 4, 30), row(1, 4, 50), row(2, 4, 0, 0.0, 0.0), row(4, 4, 90), row(5, 4, 90), row(6, 4, 90), row(7, 3, 90), row(7, 4, 60, None, None), row(1, 5, 9990, 999.0), row(3, 6, 9990, 999.0)]
    contexts = [("s", "t", gw, AT, AT, 5, "a", "b", "c", "d", AT, AT) for gw in (5, 6)]
    make = spark.createDataFrame
    return {"players": make(players, PLAYERS), "fixtures": make(fixtures, FIXTURES), "history": make(history, HISTORY), "contexts": make(contexts, CONTEXT)}


@pytest.fixture(scope="module")
def features(tables):
    return P.build_features(**tables).collect()


def test_a_row_for_each_fixture_and_blank(features):
    assert len(features[0]) == 92
    keys = sorted((r.player_id, r.target_gameweek, r.target_fixture_id or 0) for r in features)
    want = {1: [(5, 100), (6, 103)], 2: [(5, 100), (6, 103)], 3: [(5, 100), (5, 101), (6, 0)], 4: [(5, 0), (6, 103)], 5: [(5, 100), (5, 101), (6, 0)], 6: [(5, 101), (6, 0)], 7: [(5, 101), (6, 0)]}
    assert keys == sorted((i, *k) for i, own in want.items() for k in own)
    by = {(r.player_id, r.target_gameweek, r.target_fixture_id): r for r in features}
    one, away, blank = by[1, 5, 100], by[3, 5, 100], by[4, 5, None]
    assert (one.target_home_away, one.target_opponent_team_name, one.target_fixture_count) == ("H", "team20", 1)
    assert (away.target_home_away, away.target_opponent_team_id, away.target_fixture_count) == ("A", 10, 2)
    assert (blank.target_has_fixture, blank.target_fixture_count, blank.target_home_away) == (False, 0, None)


def test_windows_are_by_period_and_stop_before_the_target(features):
    by = {(r.player_id, r.target_gameweek): r for r in features}
    one = by[1, 5]
    assert (one.prior_history_rows, one.prior_appearances, one.prior_gameweeks_with_data, one.prior_total_minutes, one.history_gameweek_max_used) == (4, 4, 3, 215, 4)
    assert (one.previous_gw_minutes, one.average_prior_minutes, one.rolling_3_gameweeks_with_data, one.rolling_3_avg_minutes, one.rolling_5_gameweeks_with_data) == (80, pytest.approx(215 / 3), 2, 62.5, 3)
    assert one.prior_xg_per_90 == pytest.approx(2.0 * 90 / 215) and one.rolling_3_xgi_per_90 == pytest.approx((1.5 + 0.75) * 90 / 125)
    assert (one.previous_gw_xgi, one.cumulative_prior_saves, one.previous_gw_points) == (1.5, None, 2)
    # The second target sees the first one's period, the first one doesn't.
    assert by[1, 6].previous_gw_minutes == 9990 and by[1, 6].prior_gameweeks_with_data == 4
    none = by[3, 5]
    assert (none.prior_history_rows, none.prior_gameweeks_with_data, none.prior_total_minutes, none.previous_gameweek_has_data, none.previous_gameweek_id_used) == (0, 0, None, False, None)
    zero = by[2, 5]
    assert (zero.previous_gw_minutes, zero.prior_appearances, zero.prior_xg_per_90, zero.cumulative_prior_xg) == (0, 0, None, 0.0)


def test_chances_speak_of_one_target_only(features):
    by = {(r.player_id, r.target_gameweek): r for r in features}
    assert (by[6, 5].chance_of_playing_next_round, by[6, 5].availability_is_target_next_gameweek) == (0, True)
    assert (by[6, 6].chance_of_playing_next_round, by[6, 6].availability_is_target_next_gameweek) == (None, False)


def test_projections(tables):
    rows = P.fixture_predictions(P.build_features(**tables), F.lit("digest"))
    by = {(r.player_id, r.fixture_id): r for r in rows.where("target_gameweek = 5").collect()}
    one = by[1, 100]
    xg, xa = 2.0 * 90 / 215 * 80 / 90, 1.0 * 90 / 215 * 80 / 90
    assert (one.expected_minutes, one.appearance_points, one.goal_points_for_position) == (80.0, 2.0, 6)
    assert (one.goal_points, one.assist_points, one.fixture_points) == (pytest.approx(xg * 6), pytest.approx(xa * 3), pytest.approx(2 + xg * 6 + xa * 3))
    assert (by[2, 100].fixture_points, by[2, 100].prediction_complete, by[2, 100].attacking_rate_available) == (0.0, False, False)
    assert (by[3, 100].expected_minutes, by[3, 100].fixture_points) == (None, None)
    assert (by[4, None].expected_minutes, by[4, None].fixture_points, by[4, None].prediction_complete) == (90.0, None, False)
    assert (by[5, 100].availability_gate_reason, by[5, 100].fixture_points) == ("suspended", 0.0)
    assert (by[6, 101].availability_gate_reason, by[6, 101].availability_forced_zero) == ("explicit_zero_chance", True)
    assert (by[7, 101].availability_gate_reason, by[7, 101].expected_minutes, by[7, 101].low_sample) == (None, 60.0, True)
    total = {r.player_id: r for r in P.period_predictions(rows).where("target_gameweek = 5").collect()}
    assert (total[3].fixture_count, total[3].gameweek_points, total[3].prediction_complete) == (2, None, False)
    assert (total[4].fixture_count, total[4].gameweek_points, total[4].prediction_complete) == (0, 0.0, True)
    assert (total[5].fixture_count, total[5].gameweek_points, total[5].gameweek_expected_minutes) == (2, 0.0, 0.0)
    assert total[1].gameweek_points == pytest.approx(one.fixture_points) and total[1].feature_input_sha256 == "digest"


def test_later_history_changes_nothing(spark, tables, features):
    more = tables["history"].where("gameweek_id < 5").union(spark.createDataFrame([("s", 2, 7, 1, 90, 9, 9.0, 9.0, 9.0, 9, 9)], HISTORY))
    key = lambda r: (r.player_id, r.target_fixture_id or 0)
    again = sorted((r for r in P.build_features(**tables | {"history": more}).collect() if r.target_gameweek == 5), key=key)
    assert again == sorted((r for r in features if r.target_gameweek == 5), key=key)


def test_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (2, "b", 1.5)], "k int, s string, x double")
    one = P.input_digests({"x": df})
    assert one == P.input_digests({"x": df.repartition(3, "s")}) and one != P.input_digests({"x": df.distinct()})
    assert P.input_digests({"x": df.limit(0)}) != one


def test_backtest_states_and_bands(spark, tables):
    from panelyard.plans import evaluation as E

    rows = P.fixture_predictions(P.build_features(**tables), F.lit("digest")).where("target_gameweek = 5")
    played = spark.createDataFrame([(1, 70, 1, 0, 8, "s", 5), (1, 20, 0, 1, 3, "s", 5), (2, 0, 0, 0, 0, "s", 5), (4, 90, 1, 1, 9, "s", 5)], "player_id long, minutes int, goals long, assists long, total_points long, season string, target_gameweek int")
    by = {r.player_id: r for r in E.observations(rows, E.outcomes(played, ("season", "target_gameweek"))).collect()}
    states = {i: (r.actual_state, r.prediction_state, r.expected_minutes_band, r.availability_band) for i, r in by.items()}
    assert states == {
        1: ("actual_available", "valid_prediction", "60-89", "available"), 2: ("actual_zero_minutes", "incomplete_attacking_rate", "0", "available"), 3: ("missing_or_corrupt_actual", "missing_expected_minutes", "unknown", "available"),
        4: ("verified_blank", "verified_blank", "0", "available"), 5: ("missing_or_corrupt_actual", "valid_prediction", "0", "unavailable_or_suspended"), 6: ("missing_or_corrupt_actual", "valid_prediction", "0", "unavailable_or_suspended"), 7: ("missing_or_corrupt_actual", "valid_prediction", "60-89", "doubtful_or_chance_limited"),
    }
    assert (by[1].actual_modeled_points, by[1].actual_total_points, by[1].actual_fixture_count, by[1].prior_sample_band) == (2 + 1 + 6 + 3, 11.0, 2, "2-3_prior_GWs")
    assert (by[4].actual_minutes, by[4].actual_fixture_count, by[4].gameweek_points) == (0.0, 0, 0.0) and by[3].actual_minutes is None
    assert by[2].prior_sample_band == "no_usable_prior_attacking_sample" and by[5].prior_sample_band == "1_prior_GW"


def test_evaluation_by_hand(spark, tables):
    from panelyard.plans import evaluation as E

    rows = P.period_predictions(P.fixture_predictions(P.build_features(**tables), F.lit("d")).where("target_gameweek = 5"))
    played = spark.createDataFrame([(1, 70, 1, 0, 8), (2, 0, 0, 0, 0), (5, 10, 0, 0, 1), (99, 90, 2, 0, 12)], "player_id long, minutes int, goals long, assists long, total_points long")
    base = spark.createDataFrame([(1, 5.0, 2.0, None), (5, 3.0, None, None)], "player_id long, next_estimate double, previous_gameweek_points double, average_prior_points double")
    people = E.player_evaluation(rows, E.outcomes(played), base)
    by = {r.player_id: r for r in people.collect()}
    assert len(by) == 8 and by[1].actual_modeled_points == 2 + 6 and by[4].actual_total_points == 0.0 and by[3].actual_minutes is None
    assert (by[99].gameweek_points, by[99].actual_minutes, by[99].actual_modeled_points) == (None, 90.0, None)  # played, was never forecast
    out = {(r.target_name, r.predictor, r.group_type, r.group_value): r for r in E.evaluation(people, 2).collect()}
    whole = out["full_points", "projection", "overall", "all"]
    assert (whole.total_rows, whole.predictions, whole.actuals, whole.evaluated, whole.missing_predictions) == (8, 6, 5, 4, 2)
    assert whole.actual_top == [1, 5] and whole.overlap_pct == whole.overlap * 50.0
    other = out["full_points", "next_estimate", "overall", "all"]
    assert (other.evaluated, other.bias, other.spearman, other.predicted_top) == (2, pytest.approx(-0.5), pytest.approx(1.0), [1, 5])
    assert out["full_points", "average_prior_points", "overall", "all"].mae is None
    assert not [k for k in out if k[1] != "projection" and k[2] in ("actual_minutes", "low_sample")]
    assert out["modeled_points", "projection", "actual_minutes", "0 minutes"].total_rows == 2


def test_fixtures_are_joined_last(tables):
    plan = P.build_features(**tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "_team" in next(line for line in plan.splitlines() if "Join" in line)


def test_keys_are_those_of_the_feature_rows(features, tables):
    keys = P.feature_keys(tables["players"], tables["fixtures"], tables["contexts"]).collect()
    plain = lambda rows: sorted((r.player_id, r.target_gameweek, r.target_fixture_id or 0) for r in rows)
    assert plain(keys) == plain(features)


def test_periods_without_fixture_rows_are_those_with_them(tables):
    one = P.fixture_predictions(P.period_features(**tables), F.lit("d"))
    assert one.count() == tables["players"].count() * tables["contexts"].count()
    want = P.period_predictions(P.fixture_predictions(P.build_features(**tables), F.lit("d")))
    got = P.period_projections(one).select(want.columns)
    near = lambda df: {(r.player_id, r.target_gameweek): [pytest.approx(v) if isinstance(v, float) else v for v in r] for r in df.collect()}
    assert near(got) == {(r.player_id, r.target_gameweek): list(r) for r in want.collect()}


def test_parts_are_multiplied_before_they_are_divided(tables):
    """x * m / 90, as the SQL has it; x * (m / 90) is another double for many values, which moves them over a band's edge."""
    rows = P.fixture_predictions(P.period_features(**tables).withColumns({"prior_xg_per_90": F.lit(0.3), "previous_gw_minutes": F.lit(33).cast("bigint"), "previous_gameweek_has_data": F.lit(True), "availability_status": F.lit("a"), "chance_of_playing_next_round": F.lit(None).cast("int")}), F.lit("d"))
    assert 0.3 * 33 / 90 != 0.3 * (33 / 90)
    assert {r.expected_goals for r in rows.collect()} == {0.3 * 33 / 90}


def test_candidates_of_periods_without_fixture_rows(spark, tables):
    from panelyard.plans import opponent as O

    # Team 30 has no context: its opponents' factor is unknown.
    contexts = spark.createDataFrame([("s", gw, team, gc, xgc) for gw in (5, 6) for team, gc, xgc in ((10, 1.25, 0.8), (20, 0.75, 1.1), (90, 1.0, 0.9))], "season string, target_gameweek int, team long, factor_gc double, factor_xgc double")
    want = O.candidate_periods(O.candidate_fixtures(P.fixture_predictions(P.build_features(**tables), F.lit("d")), contexts))
    one = P.fixture_predictions(P.period_features(**tables), F.lit("d"))
    got = O.period_candidates(one, O.period_factors(tables["fixtures"], tables["contexts"], contexts)).select(want.columns)
    key = lambda r: (r.player_id, r.target_gameweek, r.candidate)
    wanted = {key(r): list(r) for r in want.collect()}
    assert {key(r): [pytest.approx(v) if isinstance(v, float) else v for v in r] for r in got.collect()} == wanted
    assert len({r[-3] for r in wanted.values()}) > 3 and any(r[5] == 2 for r in wanted.values())


def test_predictions_with_fixtures_are_those_of_feature_rows(tables):
    want = P.fixture_predictions(P.build_features(**tables), F.lit("d"))
    got = P.predictions_with_fixtures(P.fixture_predictions(P.period_features(**tables), F.lit("d")), tables["fixtures"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_keys_are_dealt_to_all_partitions_by_constant_seasons_too(tables):
    one = {k: df.withColumn("season", F.lit("s")) for k, df in tables.items() if k != "history"}
    assert P.feature_keys(**one).rdd.getNumPartitions() == 4


def test_keys_hold_their_canonical_json(tables):
    from panelyard.sources.sinks import canonical_json, content_digest, json_digest

    columns = ["player_id", "target_fixture_id", "target_gameweek"]
    keys = P.feature_keys(tables["players"], tables["fixtures"], tables["contexts"])
    assert keys.where(F.col("key") != canonical_json(columns)).count() == 0 and keys.where("target_fixture_id is null").count() > 0
    assert keys.agg(json_digest(F.col("key"))).first() == keys.agg(content_digest(columns)).first()


def test_evaluations_work_their_rows_out_once(spark):
    from panelyard import queries

    plan = queries.queries()["evaluate_forecast"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id" not in plan  # events are read while the rows are written, never again
