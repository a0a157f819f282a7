"""Decision tables over suppliers as squads of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import diff, lineup, ranks
from panelyard.plans import decision_plans
from panelyard.queries.base import POOL, panel, pool, query, sql, squads, t
from panelyard.scratch import written

P = f"WITH RECURSIVE {POOL}"


@query(f"{P}, c AS (SELECT squad_id, count(*) size, count(DISTINCT id) u, CAST(sum(price) AS BIGINT) cost, count(*) FILTER (WHERE class = 'GK') gk, count(*) FILTER (WHERE class = 'DEF') df, count(*) FILTER (WHERE class = 'MID') md, count(*) FILTER (WHERE class = 'FWD') fw FROM squads GROUP BY 1), m AS (SELECT squad_id, max(n) most FROM (SELECT squad_id, club, count(*) n FROM squads GROUP BY 1, 2) GROUP BY 1) SELECT squad_id, size, cost, array_to_string(list_sort(list_filter([CASE WHEN size <> 15 THEN 'wrong_size' END, CASE WHEN u <> size THEN 'duplicate_member' END, CASE WHEN most > 3 THEN 'club_limit' END, CASE WHEN gk <> 2 THEN 'wrong_count_GK' END, CASE WHEN df <> 5 THEN 'wrong_count_DEF' END, CASE WHEN md <> 5 THEN 'wrong_count_MID' END, CASE WHEN fw <> 3 THEN 'wrong_count_FWD' END, CASE WHEN cost > 1400 THEN 'over_budget' END], lambda x: x IS NOT NULL)), ',') violations FROM c JOIN m USING (squad_id)")
def squad_legality(s, d):
    out = lineup.squad_legality(squads(s, d), F.lit(1400))
    return out.withColumn("violations", F.array_join("violations", ","))


LINE = """rk AS (SELECT *, row_number() OVER (PARTITION BY squad_id{k}, class ORDER BY projection DESC, id) r FROM {t} WHERE projection IS NOT NULL),
fm AS (SELECT * FROM (VALUES ('3-4-3', 3, 4, 3), ('3-5-2', 3, 5, 2), ('4-3-3', 4, 3, 3), ('4-4-2', 4, 4, 2), ('4-5-1', 4, 5, 1), ('5-2-3', 5, 2, 3), ('5-3-2', 5, 3, 2), ('5-4-1', 5, 4, 1)) v(formation, d, m, f)),
tr AS (SELECT squad_id{k}, formation, count(*) n, round(sum(projection) + {c}, 8) objective, list_sort(list(id)) starters, arg_min(id, -projection * 1e7 + id) captain FROM rk CROSS JOIN fm WHERE r <= CASE class WHEN 'GK' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END GROUP BY squad_id{k}, formation HAVING count(*) = 11),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY squad_id{k} ORDER BY objective DESC, starters) b FROM tr) WHERE b = 1)"""


@query(f"{P}, {LINE.format(k='', t='squads', c='max(projection)')} SELECT squad_id, objective, array_to_string(starters, ',') starters, captain FROM bl", "objective")
def best_lineup(s, d):
    out = lineup.best_lineup(squads(s, d))
    return out.select("squad_id", "objective", F.array_join(F.transform("starters", lambda x: x.cast("string")), ",").alias("starters"), "captain")



SWAPS = """sw AS (SELECT o.squad_id, o.id out_id, p.id in_id, o.class, CAST(o.price - p.price AS INTEGER) bank_after FROM squads o JOIN pool p ON p.class = o.class AND p.projection IS NOT NULL AND p.price <= o.price
LEFT JOIN squads q ON q.squad_id = o.squad_id AND q.id = p.id LEFT JOIN (SELECT squad_id, club, count(*) n FROM squads GROUP BY 1, 2) c ON c.squad_id = o.squad_id AND c.club = p.club
WHERE q.id IS NULL AND coalesce(c.n, 0) - CASE WHEN o.club = p.club THEN 1 ELSE 0 END < 3)"""


def _heads(s, d) -> tuple[DataFrame, DataFrame]:
    """Every supplier's squad, with an empty bank; made once, since a search asks for squads many times."""
    own = written(squads(s, d), "squads")
    return own, own.select("squad_id", F.lit(0).alias("bank")).distinct()


@query(f"{P}, {SWAPS} SELECT squad_id, out_id, class, count(*) swaps, min(in_id) first_in, CAST(sum(bank_after) AS BIGINT) bank FROM sw GROUP BY 1, 2, 3")
def swap_candidates(s, d):
    """Each member's legal swaps, counted without their pairs; tests hold the counts to the pairs."""
    own, heads = _heads(s, d)
    return lineup.swap_counts(own, pool(s, d), heads)


def _scored(by: str, captain: str) -> str:
    """SQL of every swap of sw(squad_id, ..., out_id, in_id, class, bank_after, v) for the members mem: lists by class, the best formation of each."""
    own = "".join(f", list(struct_pack(id := id, v := projection) ORDER BY projection DESC) FILTER (WHERE class = '{c}' AND projection IS NOT NULL) {c}" for c in lineup.SQUAD)
    new = "".join(f", CASE WHEN s.class = '{c}' THEN list_sort(list_append(list_transform(list_filter(coalesce(l.{c}, []), lambda x: x.id <> s.out_id), lambda x: x.v), s.v), 'DESC') ELSE list_transform(coalesce(l.{c}, []), lambda x: x.v) END n{c}" for c in lineup.SQUAD)
    total = lambda p: "greatest(" + ", ".join("CASE WHEN len({0}GK) >= 1 AND len({0}DEF) >= {1} AND len({0}MID) >= {2} AND len({0}FWD) >= {3} THEN {0}GK[1] + list_sum({0}DEF[1:{1}]) + list_sum({0}MID[1:{2}]) + list_sum({0}FWD[1:{3}]) END".format(p, *f) for f in lineup.FORMATIONS) + f") + {captain} * greatest({', '.join(f'{p}{c}[1]' for c in lineup.SQUAD)})"
    keys = ", ".join(by.split())
    return f"""li AS (SELECT {keys}{own} FROM mem GROUP BY {keys}),
hl AS (SELECT *, round({total('h')}, 8) hold FROM (SELECT *{"".join(f", list_transform(coalesce({c}, []), lambda x: x.v) h{c}" for c in lineup.SQUAD)} FROM li)),
sc AS (SELECT {keys}, out_id, in_id, bank_after, hold, round({total('n')}, 8) objective FROM (SELECT s.*, l.hold{new} FROM sw s JOIN hl l USING ({keys}))),
rk AS (SELECT *, round(objective - hold, 8) gain, row_number() OVER (PARTITION BY {keys} ORDER BY objective DESC, out_id, in_id) AS rank FROM sc WHERE objective IS NOT NULL)"""


@query(f"{P}, {SWAPS.replace('p.id in_id,', 'p.id in_id, p.projection v,')}, mem AS (SELECT * FROM squads), {_scored('squad_id', '1.0')} SELECT squad_id, out_id, in_id, bank_after, hold, objective, gain, CAST(rank AS INTEGER) AS rank, rank = 1 AND gain > 1e-8 act FROM rk WHERE rank <= 10", "hold objective gain")
def swap_search(s, d):
    """The ten best swaps of each squad. Tests hold them to a brute force over line-ups too."""
    own, heads = _heads(s, d)
    return lineup.best_swaps(own, pool(s, d), heads, keep=10)


LIMITS = ", ".join(f"quantile_cont(rate, {p / 100}) p{p}" for p in decision_plans.PERCENTILES)
POOL_VIEWS = " UNION ALL ".join(
    [f"SELECT 'minimum_prior_minutes_{m}' AS view, id, class, club, price, projection FROM rl WHERE prior_minutes >= {m}" for m in decision_plans.MINIMUM_MINUTES]
    + [f"SELECT 'exclude_rates_above_position_p{p}', id, class, club, price, projection FROM rl WHERE rate <= p{p}" for p in decision_plans.PERCENTILES]
    + [f"SELECT 'cap_rates_at_position_p{p}', id, class, club, price, projection - greatest(0.0, rate - p{p}) FROM rl WHERE rate IS NOT NULL" for p in decision_plans.PERCENTILES]
    + [f"SELECT '{decision_plans.NO_CAPTAIN}', id, class, club, price, projection FROM rl"]
)
# A view's best swap of a member is one of his two newcomers of highest projection and of smallest id, since the objective rises with the projection or is level.
VIEWS = f"""{P}, rl AS (SELECT p.*, id * 7 % 12 * 45 prior_minutes, projection rate, l.* FROM pool p LEFT JOIN (SELECT class lc, {LIMITS} FROM (SELECT class, projection rate FROM pool) GROUP BY 1) l ON l.lc = p.class),
pv AS MATERIALIZED ({POOL_VIEWS}), names AS (SELECT unnest({decision_plans.sensitivity_names()}) AS view),
mem AS MATERIALIZED (SELECT n.view, s.squad_id, s.id, s.class, s.club, s.price, round(coalesce(c.projection, s.projection), 8) projection FROM squads s CROSS JOIN names n LEFT JOIN pv c ON c.view = n.view AND c.id = s.id AND n.view LIKE 'cap_rates%'),
cand AS (SELECT o.view, o.squad_id, o.id out_id, p.id in_id, round(p.projection, 8) v, o.class, o.price - p.price bank_after FROM mem o JOIN pv p ON p.view = o.view AND p.class = o.class AND p.projection IS NOT NULL AND p.price <= o.price
LEFT JOIN squads q ON q.squad_id = o.squad_id AND q.id = p.id LEFT JOIN (SELECT squad_id, club, count(*) n FROM squads GROUP BY 1, 2) c ON c.squad_id = o.squad_id AND c.club = p.club
WHERE q.id IS NULL AND coalesce(c.n, 0) - CASE WHEN o.club = p.club THEN 1 ELSE 0 END < 3),
tops AS (SELECT view, squad_id, out_id, class, min(in_id) low, arg_min(in_id, {{'v': -v, 'i': in_id}}) high FROM cand GROUP BY 1, 2, 3, 4),
sw AS (SELECT c.* FROM cand c JOIN tops t ON t.view = c.view AND t.squad_id = c.squad_id AND t.out_id = c.out_id AND (c.in_id = t.low OR c.in_id = t.high)),
{_scored('view squad_id', f"CASE WHEN view = '{decision_plans.NO_CAPTAIN}' THEN 0.0 ELSE 1.0 END")}, best AS (SELECT view, squad_id, out_id, in_id, gain, gain > 1e-8 act FROM rk WHERE rank = 1)"""


@query(f"{VIEWS} SELECT * FROM best", "gain")
def sensitivity_views(s, d):
    """Eleven what-if views of the swap search in one search; held to single searches in tests."""
    own, heads = _heads(s, d)
    return decision_plans.sensitivity_views(own, decision_plans.with_reliability(pool(s, d)), heads)


@query(f"{VIEWS} SELECT squad_id, count(*) AS views, count(*) FILTER (WHERE act) acting, count(DISTINCT (out_id, in_id)) distinct_swaps, min(gain) least_gain, max(gain) most_gain FROM best GROUP BY 1", "least_gain most_gain")
def stability_summary(s, d):
    return decision_plans.stability_summary(sensitivity_views(s, d))


@query(f"{P}, {LINE.format(k='', t='squads', c='max(projection)')}, x AS (SELECT squad_id, unnest(starters) id, captain FROM bl) SELECT id, count(*) starts, count(*) FILTER (WHERE id = captain) captaincies FROM x GROUP BY 1", name="lineup_role_counts")
def lineup_role_counts(s, d):
    return decision_plans.material_roles(lineup.best_lineup(squads(s, d)))


@query(f"{P} SELECT id, array_to_string(list_sort(list_filter([CASE WHEN projection > 9 THEN 'extreme_rate' END, CASE WHEN projection IS NULL THEN 'missing_projection' END, CASE WHEN price < 91 THEN 'low_price' END], lambda x: x IS NOT NULL)), ',') flags FROM pool WHERE projection > 9 OR projection IS NULL OR price < 91")
def reliability_flags(s, d):
    flags = decision_plans.flag_rows(pool(s, d), {"extreme_rate": F.col("projection") > 9, "missing_projection": F.col("projection").isNull(), "low_price": F.col("price") < 91})
    return flags.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))


@query(f"{P} SELECT squad_id, count(*) members, count(projection) known, count(*) FILTER (WHERE projection IS NULL) missing, count(projection) * 100.0 / count(*) coverage_pct FROM squads GROUP BY 1", "coverage_pct")
def squad_reconcile(s, d):
    return decision_plans.squad_reconcile(squads(s, d).select("squad_id", "id"), pool(s, d))


#: Line-ups in their order of projection; {k} is what else than the squad tells them apart.
ORDERED = """od AS (SELECT squad_id{k}, list(id ORDER BY projection DESC, id) ids FROM (SELECT b.squad_id{b}, unnest(b.starters) id FROM bl b) JOIN {t} USING (squad_id{k}, id) GROUP BY squad_id{k})"""
CHOSEN = """ch AS (SELECT squad_id, list(id ORDER BY id) FILTER (WHERE r <= 11) starters, list(id ORDER BY id) FILTER (WHERE r > 11) bench, min(id) captain, min(id) FILTER (WHERE r = 2) vice, list(struct_pack(id := id, class := class, p := projection)) m FROM (SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY id) r FROM squads) GROUP BY 1)"""
_IDS = "list_transform(list_filter(m, lambda x: x.class = '{0}'), lambda x: x.id)"
_COME = {c: f"list_sort(list_intersect(started, {_IDS.format(c)}))" for c in lineup.SQUAD}
_GO = {c: f"list_sort(list_intersect(benched, {_IDS.format(c)}))" for c in lineup.SQUAD}
_SAME = " || ".join(f"[i{c}[k] || '>' || o{c}[k] for k in range(1, least(len(i{c}), len(o{c})) + 1)]" for c in lineup.SQUAD)
_LEFT = {x: "list_sort(" + " || ".join(f"{x}{c}[least(len(i{c}), len(o{c})) + 1 :]" for c in lineup.SQUAD) + ")" for x in "io"}
COMPARE = f"""WITH RECURSIVE {POOL}, {LINE.format(k='', t='squads', c='max(projection)')}, {ORDERED.format(k='', b='', t='squads')}, {CHOSEN},
x AS (SELECT b.squad_id, b.objective, b.starters bs, d.ids[1] bc, d.ids[2] bv, c.starters cs, c.bench cb, c.captain cc, c.vice cv, m, list_filter(list_transform(m, lambda x: x.id), lambda x: NOT list_contains(b.starters, x)) bb FROM bl b JOIN od d USING (squad_id) JOIN ch c USING (squad_id)),
y AS (SELECT *, list_sort(list_filter(bs, lambda x: NOT list_contains(cs, x))) started, list_sort(list_filter(cs, lambda x: NOT list_contains(bs, x))) benched, list_filter(m, lambda x: list_contains(cs, x.id) AND x.p IS NOT NULL) known FROM x),
z AS (SELECT *, {', '.join(f'{_COME[c]} i{c}, {_GO[c]} o{c}' for c in lineup.SQUAD)}, CASE WHEN len(known) = len(cs) THEN round(list_sum(list_transform(known, lambda x: x.p)) + list_filter(m, lambda x: x.id = cc)[1].p, 8) END score FROM y),
w AS (SELECT *, {_SAME} same, {_LEFT['i']} li, {_LEFT['o']} lo FROM z)"""
_TEXT = lambda c: f"array_to_string({c}, ',')"


@query(f"{COMPARE} SELECT squad_id, {_TEXT('started')} started, {_TEXT('benched')} benched, {_TEXT('list_sort(list_filter(bb, lambda x: NOT list_contains(cb, x)))')} bench_added, {_TEXT('list_sort(list_filter(cb, lambda x: NOT list_contains(bb, x)))')} bench_removed, bc <> cc captain_changed, bv <> cv vice_changed, score chosen_objective, round(objective - score, 8) difference, {_TEXT(f"same || [li[k] || '>' || lo[k] for k in range(1, least(len(li), len(lo)) + 1)]")} changes FROM w", "chosen_objective difference")
def lineup_compare(s, d):
    """The eleven members of lowest id as a manager's selection, beside the best line-up."""
    sq = squads(s, d)
    placed = sq.withColumn("r", F.row_number().over(Window.partitionBy("squad_id").orderBy("id")))
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("id"))))
    chosen = placed.groupBy("squad_id").agg(some(F.col("r") <= 11).alias("starters"), some(F.col("r") > 11).alias("bench"), F.min("id").alias("captain"), F.min(F.when(F.col("r") == 2, F.col("id"))).alias("vice"))
    out = decision_plans.lineup_compare(sq, chosen, lineup.best_lineup(sq))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    pairs = F.array_join(F.transform("changes", lambda x: F.concat(x["in_id"].cast("string"), F.lit(">"), x["out_id"].cast("string"))), ",")
    return out.select("squad_id", *[text(c) for c in ("started", "benched", "bench_added", "bench_removed")], "captain_changed", "vice_changed", "chosen_objective", "difference", pairs.alias("changes"))


TOP_SWAPS = f"{SWAPS.replace('p.id in_id,', 'p.id in_id, p.projection v,')}, mem AS (SELECT * FROM squads), {_scored('squad_id', '1.0')}, top AS (SELECT squad_id, CAST(rank AS INTEGER) AS rank, out_id, in_id, rank = 1 AND gain > 1e-8 act FROM rk WHERE rank <= 10)"
# Line-ups of rank 0 are those without a swap.
ROLES = f"""{P}, {TOP_SWAPS}, after AS (SELECT squad_id, 0 AS rank, id, class, projection FROM squads UNION ALL SELECT t.squad_id, t.rank, s.id, s.class, s.projection FROM squads s JOIN top t ON t.squad_id = s.squad_id AND t.out_id <> s.id UNION ALL SELECT t.squad_id, t.rank, p.id, p.class, p.projection FROM top t JOIN pool p ON p.id = t.in_id),
{LINE.format(k=', rank', t='after', c='max(projection)').replace('rk AS', 'rl AS').replace('FROM rk CROSS', 'FROM rl CROSS')}, {ORDERED.format(k=', rank', b=', b.rank', t='after')},
r AS (SELECT squad_id, rank, unnest(ids) id, 'starting' part FROM od UNION ALL SELECT squad_id, rank, ids[1], 'captain' FROM od UNION ALL SELECT squad_id, rank, ids[2], 'vice' FROM od UNION ALL SELECT squad_id, rank, out_id, 'outgoing' FROM top UNION ALL SELECT squad_id, rank, in_id, 'incoming' FROM top)
SELECT squad_id, id, CASE rank WHEN 0 THEN 'hold' ELSE 'top_swap_' || rank END || '.' || part AS role FROM r UNION ALL SELECT r.squad_id, id, 'recommended.' || part FROM r JOIN top t ON t.squad_id = r.squad_id AND t.rank = 1 AND t.act WHERE r.rank = 1"""


@query(ROLES)
def material_roles(s, d):
    """What each player is to a squad: in its line-up, in those after its ten best swaps, in the swap that is recommended."""
    own, heads = _heads(s, d)
    return decision_plans.swap_roles(own, pool(s, d), lineup.best_swaps(own, pool(s, d), heads, keep=10))


HALVES = "a AS (SELECT entity, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) n FROM periods WHERE period <= 15 GROUP BY 1), b AS (SELECT entity, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) n FROM periods WHERE period > 15 GROUP BY 1)"


def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    p = panel(s, d).groupBy("entity", "period").agg(F.sum("minutes").alias("minutes"))
    side = lambda x: x.groupBy("entity").agg(F.sum("minutes").alias("minutes"), F.count(F.lit(1)).alias("n"))
    return side(p.where("period <= 15")), side(p.where("period > 15"))


@query(sql(f", {HALVES} SELECT coalesce(a.entity, b.entity) entity, CASE WHEN a.entity IS NULL THEN 'added' WHEN b.entity IS NULL THEN 'removed' ELSE 'changed' END status, CASE WHEN a.entity IS NULL OR b.entity IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.minutes <> b.minutes THEN 'minutes' END, CASE WHEN a.n <> b.n THEN 'n' END) END changed FROM a FULL JOIN b ON a.entity = b.entity WHERE a.entity IS NULL OR b.entity IS NULL OR a.minutes <> b.minutes OR a.n <> b.n"))
def snapshot_diff(s, d):
    a, b = _halves(s, d)
    return diff.snapshot_diff(a, b, "entity", ["minutes", "n"]).withColumn("changed", F.array_join("changed", ","))


@query(sql(f", {HALVES}, l AS (SELECT entity, unnest(['minutes', 'n']) field, CAST(unnest([minutes, n]) AS DOUBLE) v FROM a), r AS (SELECT entity, unnest(['minutes', 'n']) field, CAST(unnest([minutes, n]) AS DOUBLE) v FROM b) SELECT coalesce(l.entity, r.entity) entity, coalesce(l.field, r.field) field, l.v AS before, r.v AS after, r.v - l.v AS delta FROM l FULL JOIN r ON l.entity = r.entity AND l.field = r.field WHERE l.v IS DISTINCT FROM r.v"), "before after delta", name="run_field_diff")
def run_field_diff(s, d):
    a, b = _halves(s, d)
    return diff.run_diff(a, b, "entity", ["minutes", "n"])


# Two runs over the same suppliers: in the second, some prices and projections have moved and some parts are gone from squads.
RUNS = f"""WITH RECURSIVE {POOL.replace('squads AS (', 'first_squads AS (')}, second_squads AS (SELECT squad_id, id, class, club, price, projection FROM (SELECT l.squad_id, p.*, row_number() OVER (PARTITION BY squad_id, class ORDER BY id) r FROM (SELECT DISTINCT l_suppkey squad_id, l_partkey id FROM lineitem WHERE l_partkey % 19 <> 0) l JOIN pool p USING (id)) WHERE r <= CASE class WHEN 'GK' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END),
squads AS (SELECT 1 run, * FROM first_squads UNION ALL SELECT 2, squad_id, id, class, club, CAST(price + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS INTEGER), projection + CASE WHEN id % 7 = 0 THEN 0.5 ELSE 0 END FROM second_squads),
{LINE.format(k=', run', t='squads', c='max(projection)')}, {ORDERED.format(k=', run', b=', b.run', t='squads')},
facts AS (SELECT run, squad_id, 'squad' section, CAST(id AS VARCHAR) item, unnest(['present', 'price']) field, unnest(['yes', CAST(price AS VARCHAR)]) v FROM squads
UNION ALL SELECT run, squad_id, 'line_up', CAST(id AS VARCHAR), 'present', 'yes' FROM (SELECT run, squad_id, unnest(ids) id FROM od)
UNION ALL SELECT b.run, b.squad_id, 'selection', 'best', unnest(['present', 'formation', 'captain', 'vice']), unnest(['yes', formation, CAST(ids[1] AS VARCHAR), CAST(ids[2] AS VARCHAR)]) FROM bl b JOIN od USING (squad_id, run)
UNION ALL SELECT run, squad_id, 'manager', 'bank', unnest(['present', 'members', 'cost']), unnest(['yes', CAST(count(*) AS VARCHAR), CAST(sum(price) AS VARCHAR)]) FROM squads GROUP BY run, squad_id),
sided AS (SELECT coalesce(a.squad_id, b.squad_id) squad_id, coalesce(a.section, b.section) section, coalesce(a.item, b.item) item, coalesce(a.field, b.field) field, a.v AS before, b.v AS after FROM (SELECT * FROM facts WHERE run = 1) a FULL JOIN (SELECT * FROM facts WHERE run = 2) b ON a.squad_id = b.squad_id AND a.section = b.section AND a.item = b.item AND a.field = b.field),
changes AS (SELECT * FROM sided x WHERE before IS DISTINCT FROM after AND (field = 'present' OR (before IS NOT NULL AND after IS NOT NULL)))"""
SECTIONS = {"squad": (["id"], ["price"]), "line_up": (["id"], []), "selection": (["item"], ["formation", "captain", "vice"]), "manager": (["item"], ["members", "cost"])}


def _run(sq: DataFrame) -> dict[str, DataFrame]:
    best = lineup.best_lineup(sq)
    money = sq.groupBy("squad_id").agg(F.count(F.lit(1)).alias("members"), F.sum("price").alias("cost")).withColumn("item", F.lit("bank"))
    return {"squad": sq, "line_up": best.select("squad_id", F.explode("starters").alias("id")), "selection": best.withColumn("item", F.lit("best")), "manager": money}


def _run_changes(s, d) -> DataFrame:
    later = squads(s, d, lambda ids: ids.where("id % 19 <> 0")).withColumns({"price": (F.col("price") + F.when(F.col("id") % 17 == 0, 1).otherwise(0)).cast("int"), "projection": F.col("projection") + F.when(F.col("id") % 7 == 0, 0.5).otherwise(0.0)})
    return diff.run_changes(_run(squads(s, d)), _run(later), ["squad_id"], SECTIONS)


@query(f"{RUNS} SELECT squad_id, section, item, field, before, after FROM changes")
def run_diff(s, d):
    """What differs between two runs of every squad: members and their prices, line-ups, formation and captains, money."""
    return _run_changes(s, d)


@query(f"{RUNS} SELECT squad_id, {', '.join(f"count(*) FILTER (WHERE section = '{x}') {x}_changes" for x in SECTIONS)}, TRUE AS changed FROM changes GROUP BY 1")
def run_flags(s, d):
    return diff.run_flags(_run_changes(s, d), ["squad_id"], list(SECTIONS))


@query("WITH a AS (SELECT s_nationkey g, list(DISTINCT s_suppkey) l FROM supplier WHERE s_acctbal > 3000 GROUP BY 1), b AS (SELECT s_nationkey g, list(DISTINCT s_suppkey) l FROM supplier WHERE s_acctbal < 7000 GROUP BY 1) SELECT coalesce(a.g, b.g) s_nationkey, array_to_string(list_sort(list_filter(coalesce(b.l, []), lambda x: NOT list_contains(coalesce(a.l, []), x))), ',') added, array_to_string(list_sort(list_filter(coalesce(a.l, []), lambda x: NOT list_contains(coalesce(b.l, []), x))), ',') removed FROM a FULL JOIN b ON a.g = b.g")
def set_diff_columns(s, d):
    x = t(s, d, "supplier")
    out = diff.set_diff(x.where("s_acctbal > 3000"), x.where("s_acctbal < 7000"), "s_nationkey", "s_suppkey")
    return out.select("s_nationkey", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in ("added", "removed")])


@query(f"{P} SELECT id, class, CAST(row_number() OVER (PARTITION BY class ORDER BY projection DESC, id) AS INTEGER) AS rank FROM pool WHERE projection IS NOT NULL")
def rank_within_class(s, d):
    return lineup.rank_within_class(pool(s, d)).select("id", "class", F.col("rank").cast("int").alias("rank"))


@query(f"{P} SELECT id, class, CAST(row_number() OVER (PARTITION BY class ORDER BY projection DESC, id) AS INTEGER) AS rank, cume_dist() OVER (PARTITION BY class ORDER BY projection) * 100 percentile FROM pool WHERE projection IS NOT NULL", "percentile")
def empirical_percentile(s, d):
    return ranks.empirical_percentile(pool(s, d), ["class"], "projection").select("id", "class", F.col("rank").cast("int").alias("rank"), "percentile")


@query(f"{P} SELECT id, class, price, projection, CASE WHEN projection IS NULL THEN 'missing' WHEN projection = 0 THEN 'zero' ELSE 'valid' END state FROM pool JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = id", "projection")
def projection_join(s, d):
    sold = t(s, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return decision_plans.projection_join(sold, pool(s, d)).select("id", "class", "price", "projection", "state")


@query(f"{P} SELECT policy, count(*) n FROM (SELECT CASE WHEN projection IS NOT NULL THEN 'strict' WHEN price > 94 THEN 'appearance_only' ELSE 'rejected' END policy FROM pool) GROUP BY 1")
def policy_eligibility(s, d):
    return decision_plans.policy_eligibility(pool(s, d), F.col("price") > 94).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, engine, recorded, engine <> recorded overridden, o_orderdate < TIMESTAMP '1998-01-01' prospective FROM (SELECT *, CASE WHEN o_totalprice > 200000 THEN 'act' ELSE 'hold' END engine, CASE WHEN o_orderstatus = 'F' THEN 'act' ELSE 'hold' END recorded FROM orders)")
def action_journal_join(s, d):
    o = t(s, d, "orders")
    engine = o.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "act").otherwise("hold").alias("engine"))
    journal = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "act").otherwise("hold").alias("recorded"), F.col("o_orderdate").alias("at"))
    return decision_plans.action_journal_join(journal, engine, ["o_orderkey"], F.expr("timestamp_ntz'1998-01-01 00:00:00'")).select("o_custkey", "o_orderkey", "engine", "recorded", "overridden", "prospective")


@query("SELECT o_custkey, max(o_orderdate) latest, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-01-01') late FROM orders GROUP BY 1")
def evidence_cutoff(s, d):
    return decision_plans.evidence_cutoff(t(s, d, "orders"), ["o_custkey"], "o_orderdate", F.expr("timestamp_ntz'2001-01-01 00:00:00'"))
