"""The experiment that lends a player's rates of the season before to his first periods: who may borrow, what comes of it, which gates it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import ranks

#: Minutes that a borrowed rate weighs, and the least ones behind it.
PSEUDO_MINUTES = 450.0
PLACES = 8
CLASSES = ("GK", "DEF", "MID", "FWD")
#: Why a player may not borrow, in the order in which reasons are looked for; the last is none.
REASONS = (
    "missing_target_code", "target_code_collision", "target_position_anomaly", "no_previous_season_code_match", "previous_season_code_collision", "previous_season_source_anomaly",
    "unknown_previous_season_position", "position_mismatch", "missing_previous_season_minutes", "zero_previous_season_minutes", "previous_season_minutes_below_450", "missing_previous_season_performance",
    "missing_previous_season_xg", "nonfinite_previous_season_xg", "missing_previous_season_xa", "nonfinite_previous_season_xa", "eligible",
)
#: The periods of each scope, and what is compared in them.
SCOPES = {"GW2-5": (2, 5), "GW6-10": (6, 10), "GW11+": (11, 10_000), "overall": (0, 10_000)}
COMPONENTS = ("goal", "assist", "attacking_combined", "modeled_xfp")


def season_totals(rows: DataFrame) -> DataFrame:
    """A row per code of the season before. rows: code, player_id, class, minutes, xg, xa, performed, exception; codes that are null drop out."""
    odd = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    of = lambda c: [F.count_if(F.col("performed") & F.col(c).isNull()).alias(f"null_{c}_rows"), F.count_if(F.col("performed") & F.coalesce(odd(c), F.lit(False))).alias(f"nonfinite_{c}_rows"), F.sum(F.when(F.col("performed") & ~odd(c), F.col(c))).alias(c)]
    return rows.where("code is not null").groupBy("code").agg(
        F.count_distinct("player_id").alias("identity_count"), F.count_if("exception").alias("exception_rows"), F.min("class").alias("class"), F.sum("minutes").alias("minutes"), F.count_if("performed").alias("source_rows"), *of("xg"), *of("xa")
    )


def borrowing_reason(target: dict[str, Column], prior: dict[str, Column]) -> Column:
    """Why a player may not borrow, or 'eligible'.

    target: code, code_count, class_count, class; prior: what season_totals() has, null where the code has no season before.
    """
    some = lambda c: F.coalesce(c > 0, F.lit(False))
    minutes = prior["minutes"]
    tests = (
        target["code"].isNull(), F.coalesce(target["code_count"] != 1, F.lit(True)), F.coalesce(target["class_count"] != 1, F.lit(True)), prior["identity_count"].isNull(), prior["identity_count"] != 1, some(prior["exception_rows"]),
        ~F.coalesce(prior["class"].isin(*CLASSES), F.lit(False)), ~prior["class"].eqNullSafe(target["class"]), minutes.isNull(), minutes == 0, minutes < PSEUDO_MINUTES, ~some(prior["source_rows"]),
        some(prior["null_xg_rows"]) | prior["xg"].isNull(), some(prior["nonfinite_xg_rows"]), some(prior["null_xa_rows"]) | prior["xa"].isNull(), some(prior["nonfinite_xa_rows"]),
    )
    out = F.when(tests[0], REASONS[0])
    for test, reason in zip(tests[1:], REASONS[1:], strict=False):
        out = out.when(test, reason)
    return out.otherwise(REASONS[-1])


def with_reasons(players: DataFrame, totals: DataFrame) -> DataFrame:
    """players(player_id, code, class, class_count) with code_count, the season before as prior_*, and reason."""
    counts = players.where("code is not null").groupBy("code").agg(F.count_distinct("player_id").alias("code_count"))
    before = totals.select("code", *[F.col(c).alias(f"prior_{c}") for c in totals.columns if c != "code"])
    rows = players.join(counts, "code", "left").join(before, "code", "left")
    reason = borrowing_reason({c: F.col(c) for c in ("code", "code_count", "class_count", "class")}, {c: F.col(f"prior_{c}") for c in totals.columns if c != "code"})
    return rows.withColumn("reason", reason)


def blended_rate(event: Column, minutes: Column, previous_event: Column, previous_minutes: Column) -> Column:
    """Rate per 90 with the season before as PSEUDO_MINUTES more; null without minutes of this season."""
    before = previous_event * X.FULL_MINUTES / previous_minutes
    return F.when(minutes > 0, (event + before * PSEUDO_MINUTES / X.FULL_MINUTES) * X.FULL_MINUTES / (minutes + PSEUDO_MINUTES))


def candidates(periods: DataFrame, players: DataFrame) -> DataFrame:
    """player_id, period, and the components of C0, C1 and the actual: columns c0_<component>, c1_<component>, actual_<component>.

    periods: player_id, period, minutes, xg, xa, goals, assists, a row per player and period played. players: what
    with_reasons() gives. A row stands for its own period as target: everything but the actuals comes from before it.
    """
    before = Window.partitionBy("player_id").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("player_id").orderBy("period").rangeBetween(-1, -1)
    rows = periods.withColumns({f"_{c}": F.sum(c).over(before) for c in ("minutes", "xg", "xa")} | {"_last": F.max("minutes").over(last)})
    rows = rows.join(players, "player_id")
    expected = X.clamp(F.col("_last").cast("double"))
    points, share = X.class_points(F.col("class")), expected / X.FULL_MINUTES
    borrows = F.col("reason") == REASONS[-1]
    cols = {"_appearance": X.appearance_points(expected), "_played": X.appearance_points(F.col("minutes").cast("double"))}
    for part, event, worth in (("goal", "xg", points), ("assist", "xa", F.lit(X.ASSIST_POINTS))):
        own = X.per_90(F.col(f"_{event}"), F.col("_minutes"))
        lent = F.when(borrows, blended_rate(F.col(f"_{event}"), F.col("_minutes"), F.col(f"prior_{event}"), F.col("prior_minutes"))).otherwise(own)
        cols |= {f"c0_{part}": own * share * worth, f"c1_{part}": lent * share * worth, f"actual_{part}": F.col(f"{part}s") * worth}
    rows = rows.withColumns(cols)
    sums = {}
    for side, appearance in (("c0", "_appearance"), ("c1", "_appearance"), ("actual", "_played")):
        both = F.col(f"{side}_goal") + F.col(f"{side}_assist")
        sums |= {f"{side}_attacking_combined": both, f"{side}_modeled_xfp": F.col(appearance) + both}
    rows = rows.withColumns(sums)
    # Rounded, so that projections which are equal but for the order of their sums are ties.
    return rows.select("player_id", "period", *[F.round(f"{side}_{c}", PLACES).alias(f"{side}_{c}") for c in COMPONENTS for side in ("c0", "c1", "actual")])


def common_metrics(rows: DataFrame) -> DataFrame:
    """scope, component, pairs and, of C0 and C1 on the pairs that both predict, mae, rmse, bias, spearman and their changes."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"c0_{c}").alias("c0"), F.col(f"c1_{c}").alias("c1"), F.col(f"actual_{c}").alias("actual")) for c in COMPONENTS]))
    scopes = F.explode(F.array_compact(F.array(*[F.when(F.col("period").between(low, high), F.lit(name)) for name, (low, high) in SCOPES.items()])))
    long = rows.select("period", parts.alias("_p")).select(scopes.alias("scope"), "_p.*").where("c0 is not null and c1 is not null and actual is not null")
    cols = [F.count(F.lit(1)).alias("pairs")]
    for side in ("c0", "c1"):
        e = F.col(side) - F.col("actual")
        cols += [F.avg(F.abs(e)).alias(f"{side}_mae"), F.sqrt(F.avg(e * e)).alias(f"{side}_rmse"), F.avg(e).alias(f"{side}_bias")]
    by = ["scope", "component"]
    out = long.groupBy(*by).agg(*cols)
    out = out.join(ranks.spearman_against(long, ["c0", "c1"], "actual", by).drop("pairs"), by, "left")
    fall = lambda m: F.try_divide((F.col(f"c0_{m}") - F.col(f"c1_{m}")) * 100.0, F.nullif(F.col(f"c0_{m}"), F.lit(0.0)))
    return out.withColumns({"mae_improvement": fall("mae"), "rmse_improvement": fall("rmse"), "absolute_bias_increase": F.abs("c1_bias") - F.abs("c0_bias"), "spearman_change": F.col("c1_spearman") - F.col("c0_spearman")})


def coverage(rows: DataFrame) -> DataFrame:
    """candidate, coverage_pct: how many of the rows have a modeled projection."""
    share = lambda side: F.count(f"{side}_modeled_xfp") * 100.0 / F.count(F.lit(1))
    both = rows.agg(share("c0").alias("c0"), share("c1").alias("c1"))
    return both.select(F.explode(F.array(F.struct(F.lit("C0").alias("candidate"), F.col("c0").alias("coverage_pct")), F.struct(F.lit("C1").alias("candidate"), F.col("c1").alias("coverage_pct")))).alias("_c")).select("_c.*")


def gate_specs() -> list[tuple[str, str, str, str, str, float]]:
    """(group, gate, what is compared, of which component, comparison, threshold). Fixed values, in order.

    A worsening is an improvement's negative; best and other are the larger and the smaller of goal's and assist's change.
    """
    out = [
        ("GW2-5", "combined_attacking_mae_improves_5pct", "mae_improvement", "attacking_combined", ">=", 5.0), ("GW2-5", "combined_attacking_rmse_improves_3pct", "rmse_improvement", "attacking_combined", ">=", 3.0),
        ("GW2-5", "best_goal_or_assist_spearman_improves_0_02", "best_spearman", "goal", ">=", 0.02), ("GW2-5", "other_component_spearman_declines_no_more_0_01", "other_spearman", "goal", ">=", -0.01),
        ("GW2-5", "modeled_xfp_mae_improves_3pct", "mae_improvement", "modeled_xfp", ">=", 3.0), ("GW2-5", "modeled_xfp_rmse_does_not_worsen", "rmse_worsening", "modeled_xfp", "<=", 0.0),
    ]
    for scope, prefix in (("GW6-10", "gw6_10"), ("GW11+", "gw11_plus")):
        out += [(scope, f"{prefix}_combined_attacking_mae_worsens_no_more_1pct", "mae_worsening", "attacking_combined", "<=", 1.0), (scope, f"{prefix}_modeled_xfp_mae_worsens_no_more_1pct", "mae_worsening", "modeled_xfp", "<=", 1.0), (scope, f"{prefix}_modeled_xfp_rmse_worsens_no_more_1pct", "rmse_worsening", "modeled_xfp", "<=", 1.0)]
        out += [(scope, f"{prefix}_{c}_spearman_declines_no_more_0_01", "spearman_change", c, ">=", -0.01) for c in ("goal", "assist", "modeled_xfp")]
    out += [("overall", f"{name}_absolute_bias_increase_no_more_0_05", "absolute_bias_increase", c, "<=", 0.05) for name, c in (("combined_attacking", "attacking_combined"), ("modeled_xfp", "modeled_xfp"))]
    return [*out, ("overall", "prediction_coverage_falls_no_more_1pp", "coverage_drop", "coverage", "<=", 1.0)]


def development_gates(common: DataFrame, covered: DataFrame) -> DataFrame:
    """scope, gate, c0, c1, change, comparison, threshold, passed for the 21 gates; a change that is unknown fails.

    common has a row for each scope and component and covered one for each candidate; both travel as one small map.
    """
    values = common.select(F.concat_ws("|", "scope", "component").alias("k"), F.struct(*[c for c in common.columns if c not in ("scope", "component")]).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    of = covered.agg(*[F.max(F.when(F.col("candidate") == c, F.col("coverage_pct"))).alias(c) for c in ("C0", "C1")])
    one = values.join(of, F.lit(True))  # one row each
    rows = []
    for scope, gate, what, component, comparison, threshold in gate_specs():
        at = lambda field, c=component: F.try_element_at("m", F.lit(f"{scope}|{c}"))[field]  # noqa: B023, E731
        if what == "coverage_drop":
            c0, c1, change = F.col("C0"), F.col("C1"), F.col("C0") - F.col("C1")
        elif what.endswith("_spearman"):
            pick = F.greatest if what.startswith("best") else F.least
            known = at("spearman_change", "goal").isNotNull() & at("spearman_change", "assist").isNotNull()
            c0, c1, change = [F.when(known, pick(at(f, "goal"), at(f, "assist"))) for f in ("c0_spearman", "c1_spearman", "spearman_change")]
        else:
            measure = "bias" if what == "absolute_bias_increase" else what.split("_")[0]
            c0, c1 = at(f"c0_{measure}"), at(f"c1_{measure}")
            change = -at(f"{measure}_improvement") if what.endswith("worsening") else at(what)
        met = change >= threshold if comparison == ">=" else change <= threshold
        rows.append(F.struct(F.lit(scope).alias("scope"), F.lit(gate).alias("gate"), c0.alias("c0"), c1.alias("c1"), change.alias("change"), F.lit(comparison).alias("comparison"), F.lit(threshold).alias("threshold"), F.coalesce(met, F.lit(False)).alias("passed")))
    return one.select(F.explode(F.array(*rows)).alias("_g")).select("_g.*")


def decision(gates: DataFrame) -> DataFrame:
    """One row: how many gates there are, how many passed, and whether all did."""
    return gates.agg(F.count(F.lit(1)).alias("gates"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("qualifies"))
