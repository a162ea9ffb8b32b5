"""Check queries: policy, metrics, calibration, committee and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.functions import vocab
from firstprint.operators import calibrate as K
from firstprint.operators import committee as CM
from firstprint.operators import metrics as M
from firstprint.operators import policy as P
from firstprint.operators.ordering import temporal_split
from firstprint.plans import evaluation as E
from firstprint.plans.catalog_data import FOLDS, augmented, snapshots
from firstprint.plans.oracle import compose, grid_values, rd
from firstprint.plans.registry import query, shared, tidy
from firstprint.session import materialise
from firstprint.sources import fixtures as fx

ORDER = ["asof_date", "row_id"]


def acted(spark, d):
    return P.with_action(fx.scored(spark, d)).withColumn("fold_id", F.col("yr") - 1995)


def _share(cond: str, within: str | None = None) -> str:
    den = f"nullif(count(*) filter (where {within}),0)" if within else "nullif(count(*),0)"
    num = f"count(*) filter (where {cond}{' and ' + within if within else ''})"
    return f"coalesce({num}/{den}::double,0)"


_MIX = (f"count(*) n, {rd(_share(chr(39).join(['action=', 'FOLD', ''])))} fold_pct, "
        f"{rd(_share(chr(39).join(['action=', 'SMALL_BET', ''])))} small_bet_pct, {rd(_share(chr(39).join(['action=', 'SIZE_UP', ''])))} size_up_pct")
_FSR = rd(_share("action='SIZE_UP'", "severe_30=1"))
_DET = rd(_share("action='FOLD'", "adverse_20=1"))
_BRIER = "avg((p_tail-adverse_20)*(p_tail-adverse_20))"
_CLIMO = "avg(adverse_20)*(1-avg(adverse_20))"

# ---- policy ------------------------------------------------------------------------------------------


@query("a15_action_counts", compose("select action, count(*) n from acted group by 1", "acted"))
def _(spark, d):
    return P.action_counts(acted(spark, d))


@query("a16_false_safe_rate", compose(f"select sector, {_FSR} false_safe_rate from acted group by 1", "acted"))
def _(spark, d):
    return tidy(P.false_safe_rate(acted(spark, d), ["sector"]))


@query("a17_coverage_report", compose(f"select yr, {_MIX}, {_FSR} false_safe_rate, {_DET} adverse_detection_rate from acted group by 1", "acted"))
def _(spark, d):
    return tidy(P.coverage_report(acted(spark, d), ["yr"]))


@query("a18_feasibility_report", compose("with p as (select avg(severe_30) p from scored) select " + rd("p") + " p_severe, " + ", ".join(
    f"{rd(f'case when p<=0 then 0 else greatest(0,(p-(1-{c}::double))/p) end')} min_fsr_at_{int(c * 100)}pct_sizeup, "
    f"(case when p<=0 then 0 else greatest(0,(p-(1-{c}::double))/p) end<=0.1::double)::int::double feasible_at_{int(c * 100)}pct_sizeup"
    for c in (0.2, 0.3, 0.4, 0.5)) + f", {rd('greatest(0,1-p*(1-0.1::double))')} max_feasible_sizeup from p", "scored"))
def _(spark, d):
    return tidy(P.feasibility_report(fx.scored(spark, d)))


@query("a19_enough_events", compose("select sum(severe_30)::bigint n_severe, sum(severe_30)>=50 should_calibrate from scored", "scored"))
def _(spark, d):
    return P.enough_events(fx.scored(spark, d))


_GRID_REPORT = f"""r as (select {{keys}} ord, fold_min, small_bet_min, count(*) n, count(*) filter (where p>=fold_min)/count(*)::double fold_pct,
      count(*) filter (where p<fold_min and p>=small_bet_min)/count(*)::double small_bet_pct, count(*) filter (where p<small_bet_min)/count(*)::double size_up_pct,
      coalesce(count(*) filter (where severe_30=1 and p<small_bet_min)/nullif(sum(severe_30),0)::double,0) false_safe_rate,
      coalesce(count(*) filter (where adverse_20=1 and p>=fold_min)/nullif(sum(adverse_20),0)::double,0) adverse_detection_rate
    from src, {grid_values()} group by all),
  q as (select *, {{ok}} feasible from r),
  pick as (select *, row_number() over (partition by {{part}} order by (ord>=0 and feasible and size_up_pct>{{floor}}) desc,
      case when ord>=0 and feasible then size_up_pct end desc nulls last, ord) rk, 1 one from
      (select *, max(case when ord=-1 then size_up_pct end) over (partition by {{part}}) base from q))"""
_OK = ("false_safe_rate<={fsr}::double and size_up_pct>=0.1::double and small_bet_pct>={sb}::double and fold_pct<=0.8::double")
_REPORT = ", ".join(f"{rd(c)} as {c}" for c in P.REPORT)


def best_sql(src: str, ok: str, keys: str = "", floor: str = "base", extra: str = "") -> str:
    """The chosen grid point per key; where no point qualifies the default row (ord -1) is taken."""
    body = _GRID_REPORT.format(keys=keys + ", " if keys else "", ok=ok, part=keys or "1", floor=floor)
    chosen = (f"fin as (select * from pick where case when ord>=0 then rk=1 and feasible and size_up_pct>{floor} "
              f"else not exists (select 1 from pick z where z.ord>=0 and z.feasible and z.size_up_pct>z.base{''.join(f' and z.{k.strip()}=pick.{k.strip()}' for k in keys.split(',') if k)}) end)")
    return f"with src as ({src}), {body}, {chosen} {extra}"


@query("j11_threshold_grid", compose("with src as (select p_tail p, severe_30, adverse_20 from scored), " + _GRID_REPORT.format(
    keys="", ok=_OK.format(fsr=0.03, sb=0.12), part="1", floor="base") + f" select ord, {rd('fold_min')} fold_min, {rd('small_bet_min')} small_bet_min, n, {_REPORT}, feasible from q", "scored"))
def _(spark, d):
    return tidy(P.grid_reports(fx.scored(spark, d), constraints=E.STABILITY))


_PICKED = f"select {{k}}{rd('fold_min')} fold_min, {rd('small_bet_min')} small_bet_min, n, {_REPORT}, feasible from fin"


@query("e01_optimise_thresholds", compose(best_sql("select p_tail p, severe_30, adverse_20 from scored", "false_safe_rate<=0.1::double", extra=_PICKED.format(k="")), "scored"))
def _(spark, d):
    return tidy(P.optimise_thresholds(fx.scored(spark, d), constraints=P.Constraints(0.10)))


@query("e02_optimise_constrained", compose(best_sql("select yr, p_tail p, severe_30, adverse_20 from scored", _OK.format(fsr=0.03, sb=0.12), "yr", extra=_PICKED.format(k="yr, ")), "scored"))
def _(spark, d):
    return tidy(P.optimise_thresholds(fx.scored(spark, d), constraints=E.STABILITY, group=["yr"]))


@query("e03_rank_policy", compose("""select row_id, case when p_tail>=f then 'FOLD' when p_tail>=s then 'SMALL_BET' else 'SIZE_UP' end as action
    from scored, (select quantile_cont(p_tail,0.75) f, quantile_cont(p_tail,0.5) s from scored)""", "scored"))
def _(spark, d):
    return P.assign_by_rank(fx.scored(spark, d), "p_tail").select("row_id", "action")


_PAIRS = "(values (-1,0.75::double,0.5::double)," + ",".join(f"({i},{f!r}::double,{s!r}::double)" for i, (f, s) in enumerate(P.rank_grid())) + ") g(ord,fold_min,small_bet_min)"


@query("e04_rank_grid", compose(f"""with lv as (select q, (select quantile_cont(p_tail,0.5) from scored) z from (select distinct fold_min q from {_PAIRS} union select small_bet_min from {_PAIRS})),
    arr as (select list(p_tail order by p_tail) a, count(*) n from scored),
    cut as (select q, a[floor((n-1)*q)::int+1]+(a[ceil((n-1)*q)::int+1]-a[floor((n-1)*q)::int+1])*((n-1)*q-floor((n-1)*q)) c from lv, arr),
    gc as (select g.*, cf.c f, cs.c s from {_PAIRS} join cut cf on cf.q=fold_min join cut cs on cs.q=small_bet_min),
    r as (select ord, fold_min, small_bet_min, count(*) n, count(*) filter (where p_tail>=f)/count(*)::double fold_pct,
      count(*) filter (where p_tail<f and p_tail>=s)/count(*)::double small_bet_pct, count(*) filter (where p_tail<f and p_tail<s)/count(*)::double size_up_pct,
      count(*) filter (where severe_30=1 and p_tail<f and p_tail<s)/sum(severe_30)::double false_safe_rate,
      count(*) filter (where adverse_20=1 and p_tail>=f)/sum(adverse_20)::double adverse_detection_rate from scored, gc group by 1,2,3),
    q as (select *, false_safe_rate<=0.05::double and size_up_pct>=0.1::double and fold_pct<=0.8::double feasible from r)
    select {rd('fold_min')} fold_min, {rd('small_bet_min')} small_bet_min, n, {_REPORT}, feasible from q
    where ord>=0 and feasible or ord=-1 order by ord>=0 desc, size_up_pct desc, ord limit 1""", "scored"))
def _(spark, d):
    return tidy(P.optimise_rank_policy(fx.scored(spark, d), "p_tail", E.CHALLENGER))


def method_rows(spark, d):
    """The scored rows under three score maps standing in for calibrators."""
    maps = {"plain": F.col("p_tail"), "shrunk": F.col("p_tail") * 0.75, "coarse": F.floor(F.col("p_tail") * 4).cast("double") / 4}
    return fx.scored(spark, d).select("row_id", "severe_30", "adverse_20", F.inline(F.array(*[
        F.struct(F.lit(n).alias("method"), p.alias("p")) for n, p in maps.items()])))


_METHODS = """select 'plain' as method, p_tail p, severe_30, adverse_20 from scored union all select 'shrunk', p_tail*0.75::double, severe_30, adverse_20 from scored
    union all select 'coarse', floor(p_tail*4)/4, severe_30, adverse_20 from scored"""
_CHALLENGED = best_sql(_METHODS, _OK.format(fsr=0.05, sb=0.0), "method", extra=f""", sk as (select method, avg((p-adverse_20)*(p-adverse_20)) brier, avg(adverse_20)*(1-avg(adverse_20)) bc,
      count(distinct round_even(p,4)) n_unique from src group by 1),
    ch as (select method as name, {rd('fold_min')} fold_min, {rd('small_bet_min')} small_bet_min, n, {_REPORT}, feasible, {rd('brier')} brier, {rd('1-brier/bc')} bss, n_unique,
      n_unique>=8 granularity_ok, small_bet_pct between 0.1::double and 0.4::double coverage_ok,
      n_unique>=8 and small_bet_pct between 0.1::double and 0.4::double gate_passed from fin join sk using (method))""")


def challenger_table(spark, d):
    rows = method_rows(spark, d)
    skills = K.skill_by_method(rows, "adverse_20").join(rows.groupBy("method").agg(M.distinct_levels("p").alias("n_unique")), "method")
    best = P.optimise_thresholds(rows, "p", E.CHALLENGER, ["method"])
    return P.challenger_gates(best.join(skills.drop("brier_climatology"), "method").withColumnRenamed("method", "name"))


@query("e05_calibrated_challengers", compose(_CHALLENGED + " select * from ch", "scored"))
def _(spark, d):
    return tidy(challenger_table(spark, d))


@query("t06_champion", compose(_CHALLENGED + " select * from ch where gate_passed order by false_safe_rate, size_up_pct desc, bss desc nulls last, name limit 1", "scored"))
def _(spark, d):
    return tidy(P.select_champion(challenger_table(spark, d)))


@query("t05_best_grid_point", compose(best_sql("select sector, p_tail p, severe_30, adverse_20 from scored", _OK.format(fsr=0.02, sb=0.0), "sector", extra=_PICKED.format(k="sector, ")), "scored"))
def _(spark, d):
    c = P.Constraints(0.02, min_size_up_pct=0.10, min_small_bet_pct=0.0, max_fold_pct=0.80)
    return tidy(P.optimise_thresholds(fx.scored(spark, d), constraints=c, group=["sector"]))


# ---- metrics and diagnostics ---------------------------------------------------------------------------

@query("a20_brier_skill", compose(f"select sector, {rd(_BRIER)} brier, {rd(_CLIMO)} brier_climatology, {rd(f'1-{_BRIER}/({_CLIMO})')} bss from scored group by 1", "scored"))
def _(spark, d):
    return tidy(M.brier_report(fx.scored(spark, d), "p_tail", "adverse_20", ["sector"]))


@query("a21_error_by_group", compose(f"""select coalesce(sector,'_overall') group_value, {rd('avg(abs(p_tail-adverse_20))')} mae,
    {rd(_BRIER)} mse from scored group by rollup(sector)""", "scored"))
def _(spark, d):
    return tidy(M.error_report(fx.scored(spark, d), "p_tail", "adverse_20", "sector"))


@query("a22_constant_baseline", compose(f"""with m as (select avg(p_tail) m from scored where yr<=1998)
    select {rd('avg(abs(p_tail-m))')} mae, {rd('avg((p_tail-m)*(p_tail-m))')} mse, count(*) n from scored, m where yr>1998""", "scored"))
def _(spark, d):
    s = fx.scored(spark, d)
    mean = s.where("yr <= 1998").agg(F.avg("p_tail").alias("m"))
    err = F.col("p_tail") - F.col("m")
    return tidy(s.where("yr > 1998").join(F.broadcast(mean)).agg(  # one row
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.count(F.lit(1)).alias("n")))


@query("a24_sector_metrics", compose(f"""select (yr-1995)::int fold_id, sector, count(*) n, {rd('avg(severe_30)')} severe_rate, {rd('avg(adverse_20)')} adverse_rate,
    {rd("count(*) filter (where adverse_20=1 and action='FOLD')/nullif(sum(adverse_20),0)::double")} detection,
    {rd("count(*) filter (where severe_30=1 and action='SIZE_UP')/nullif(sum(severe_30),0)::double")} false_safe_rate,
    {_MIX.split(', ', 1)[1]} from acted group by 1,2""", "acted"))
def _(spark, d):
    return tidy(M.sector_report(acted(spark, d)))


@query("a25_calibration_by_fold", compose(f"""select (yr-1995)::int fold_id, {rd('avg(p_tail)')} mean_p, {rd('avg(adverse_20)')} mean_y, {rd('avg(p_tail)/avg(adverse_20)')} ratio,
    {rd('covar_samp(adverse_20,p_tail)/var_pop(p_tail)')} slope, {rd('regr_slope(adverse_20,p_tail)')} ols_slope from acted group by 1""", "acted"))
def _(spark, d):
    return tidy(M.calibration_by_fold(acted(spark, d)))


@query("a26_sector_fsr", compose(f"select {rd(_share(chr(39).join(['action=', 'SIZE_UP', '']), chr(39).join(['severe_30=1 and sector=', '1-URGENT', ''])))} false_safe_rate from acted", "acted"))
def _(spark, d):
    return tidy(P.false_safe_rate(acted(spark, d), where=F.col("sector") == "1-URGENT"))


_FOLD_METRICS = f"""select {{k}}(yr-1995)::int fold_id, coalesce(count(*) filter (where severe_30=1 and action='SIZE_UP')/nullif(sum(severe_30),0)::double,0) fsr,
    1-{_BRIER}/({_CLIMO}) bss, count(*) filter (where action='SMALL_BET')/count(*)::double small_bet_pct,
    coalesce(count(*) filter (where severe_30=1 and action='SIZE_UP' and sector='1-URGENT')/nullif(count(*) filter (where severe_30=1 and sector='1-URGENT'),0)::double,0) tech_fsr
    from {{t}} group by all"""


@query("a27_acceptance_gates", compose("with f as (" + _FOLD_METRICS.format(k="", t="acted") + """) select quantile_cont(fsr,0.5)<=0.1::double med_fsr_pass, max(fsr)<=0.15::double worst_fsr_pass,
    quantile_cont(bss,0.5)>0 med_bss_pass, quantile_cont(small_bet_pct,0.5)>=0.1::double med_small_pass,
    quantile_cont(fsr,0.5)<=0.1::double and max(fsr)<=0.15::double and quantile_cont(bss,0.5)>0 and quantile_cont(small_bet_pct,0.5)>=0.1::double all_pass from f""", "acted"))
def _(spark, d):
    return M.acceptance_gates(M.policy_metrics(acted(spark, d), ["fold_id"]))


_CUTS = {"baseline": (0.6, 0.3), "tight": (0.5, 0.2), "wide": (0.7, 0.4)}


def variant_metrics(spark, d):
    """The same scores under three threshold pairs, as variants to compare per fold."""
    v = F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(a).alias("f"), F.lit(b).alias("s")) for n, (a, b) in _CUTS.items()]))
    rows = fx.scored(spark, d).select("*", v).withColumns({
        "action": X.action_of(F.col("p_tail"), F.col("f"), F.col("s")), "fold_id": F.col("yr") - 1995,
        "p_tail": F.when(F.col("variant") == "tight", F.col("p_tail") * 0.9).otherwise(F.col("p_tail"))})
    return M.policy_metrics(rows, ["variant", "fold_id"], watched_sector="1-URGENT")


_VAR = "va as (" + " union all ".join(
    f"select '{n}' as variant, yr, sector, adverse_20, severe_30, {'p_tail*0.9::double' if n == 'tight' else 'p_tail'} p_tail, "
    f"case when p_tail>={a}::double then 'FOLD' when p_tail>={b}::double then 'SMALL_BET' else 'SIZE_UP' end as action from scored" for n, (a, b) in _CUTS.items()
) + "), m as (" + _FOLD_METRICS.format(k="variant, ", t="va") + "), dl as (select m.*, m.bss-b.bss d_bss, m.tech_fsr-b.tech_fsr d_tech from m join m b on b.variant='baseline' and b.fold_id=m.fold_id)"


@query("j15_delta_to_baseline", compose(f"with {_VAR} select variant, fold_id, {rd('bss')} bss, {rd('d_bss')} d_bss, {rd('fsr')} fsr, {rd('tech_fsr')} tech_fsr from dl", "scored"))
def _(spark, d):
    return tidy(M.deltas_to_baseline(variant_metrics(spark, d)).select("variant", "fold_id", "bss", "d_bss", "fsr", "tech_fsr"))


@query("a28_ablation_gates", compose(f"""with {_VAR}, g as (select variant, max(fsr) worst_fsr, max(d_bss) filter (where fold_id=3) last_fold_lift,
      max(d_tech) filter (where fold_id=3) last_fold_d_tech_fsr, quantile_cont(small_bet_pct,0.5) median_small_bet from dl where variant<>'baseline' group by 1)
    select variant, {rd('worst_fsr')} worst_fsr, {rd('last_fold_lift')} last_fold_lift, {rd('last_fold_d_tech_fsr')} last_fold_d_tech_fsr, {rd('median_small_bet')} median_small_bet,
      worst_fsr<=0.1::double fsr_pass, last_fold_lift>=0.05::double lift_pass, last_fold_d_tech_fsr<=0 tech_pass, median_small_bet>=0.08::double small_pass,
      worst_fsr<=0.1::double and last_fold_lift>=0.05::double and last_fold_d_tech_fsr<=0 and median_small_bet>=0.08::double all_pass from g""", "scored"))
def _(spark, d):
    return tidy(M.ablation_gates(variant_metrics(spark, d)))


@query("a31_distinct_levels", compose("select sector, count(distinct round_even(p_tail*p_tail,4)) n_unique from scored group by 1", "scored"))
def _(spark, d):
    s = fx.scored(spark, d).withColumn("p2", F.col("p_tail") * F.col("p_tail"))
    return s.groupBy("sector").agg(M.distinct_levels("p2").alias("n_unique"))


_E11 = f"""c as (select (yr-1995)::int fold_id, sector, count(*) n, sum(adverse_20) na, count(*) filter (where adverse_20=1 and action='FOLD') nh from acted group by 1,2),
    w as (select sector, n::double w from c where fold_id=3)"""
_E11_OUT = f"""select fold_id, {rd('sum(nh)/sum(na)::double')} actual_detection, {rd('sum(w*nh/na) filter (where na>0)/sum(w) filter (where na>0)')} reweighted_detection
    from c left join w using (sector) where fold_id<3 group by 1"""


@query("e11_reweighted_detection", compose(f"with {_E11} {_E11_OUT}", "acted"))
def _(spark, d):
    return tidy(M.reweighted_detection(acted(spark, d), 3))


@query("j13_fold_sector_join", compose(f"with {_E11} {_E11_OUT}", "acted"))
def _(spark, d):
    return tidy(M.reweighted_detection(acted(spark, d), 3))


# ---- calibrators -----------------------------------------------------------------------------------------

_NEWTON = f"""with recursive lv as (select sector, p_tail s, count(*)::double n, sum(adverse_20)::double pos from scored group by 1,2),
    it as (select 0 i, sector, 0::double w, ln((sum(pos)+0.5::double)/(sum(n)-sum(pos)+0.5::double)) b from lv group by sector
      union all select i+1, sector, w-(hbb*gw-hwb*gb)/(hww*hbb-hwb*hwb), b-(hww*gb-hwb*gw)/(hww*hbb-hwb*hwb) from
        (select i, sector, w, b, w+sum(p*n*s-pos*s) gw, sum(p*n-pos) gb, 1+sum(n*p*(1-p)*s*s) hww, sum(n*p*(1-p)*s) hwb, sum(n*p*(1-p)) hbb
         from (select it.*, lv.s, lv.n, lv.pos, 1/(1+exp(-(it.w*lv.s+it.b))) p from it join lv on lv.sector=it.sector where i<15) group by i, sector, w, b))
    select sector, {rd('w', 5)} slope, {rd('b', 5)} intercept from it where i=15"""


@query("m04_platt", compose(_NEWTON, "scored").replace("with scored", "with recursive scored", 1).replace(",\nrecursive lv", ",\nlv", 1))
def _(spark, d):
    return tidy(K.fit_platt(fx.scored(spark, d), "p_tail", "adverse_20", "sector").drop("converged"), 5)


_ISO = f"""with lv as (select p_tail s, count(*)::double n, sum(adverse_20)::double pos, row_number() over (order by p_tail) i from scored group by 1),
    cum as (select i, s, sum(n) over (order by i) cn, sum(pos) over (order by i) cp, n, pos from lv),
    ab as (select a.i a, b.i b, (b.cp-a.cp+a.pos)/(b.cn-a.cn+a.n) v from cum a join cum b on b.i>=a.i),
    mn as (select a, b, min(v) over (partition by a order by b desc rows unbounded preceding) v from ab)
    select s score, {rd('max(v)')} p from mn join lv on lv.i=mn.b group by 1"""


@query("m05_isotonic", compose(_ISO, "scored"))
def _(spark, d):
    s = fx.scored(spark, d).withColumn("g", F.lit(0))
    levels = s.select("p_tail", "g").distinct()
    return tidy(K.fit_apply("isotonic", s, levels, "p_tail", "adverse_20", "g").select(F.col("p_tail").alias("score"), "p"))


def _pass_sql(n: int = 4) -> str:
    """The forward monotone pass over columns p0..p{n-1}, one CTE per step."""
    steps, prev = [], "b0"
    for i in range(n - 1):
        inside = {j: " and ".join(f"p{m}<p{i}" for m in range(i + 1, j + 1)) for j in range(i + 1, n)}
        total = f"(p{i}" + "".join(f"+case when {inside[j]} then p{j} else 0 end" for j in inside) + ")"
        count = "(1" + "".join(f"+case when {inside[j]} then 1 else 0 end" for j in inside) + ")"
        cols = [f"p{m}" for m in range(i)]
        cols.append(f"case when p{i}>p{i + 1} then {total}/{count} else p{i} end p{i}")
        cols += [f"case when p{i}>p{i + 1} and {inside[j]} then {total}/{count} else p{j} end p{j}" for j in inside]
        steps.append(f"b{i + 1} as (select {{k}}, e1, e2, e3, {', '.join(cols)} from {prev})")
        prev = f"b{i + 1}"
    return ", ".join(steps)


def binned_sql(src: str, key: str) -> str:
    """Edges, smoothed bin rates and the monotone pass per key of ``src`` (key, s, y)."""
    rates = ", ".join(
        f"(coalesce(sum(y) filter (where bin={i}),0)+1)::double/(count(*) filter (where bin={i})+2) p{i}" for i in range(4))
    return f"""src as ({src}), ed as (select {key}, quantile_cont(s,0.25) e1, quantile_cont(s,0.5) e2, quantile_cont(s,0.75) e3 from src group by 1),
      bn as (select src.*, e1, e2, e3, (s>=e1)::int+(s>=e2)::int+(s>=e3)::int bin from src join ed using ({key})),
      b0 as (select {key}, e1, e2, e3, {rates} from bn group by 1,2,3,4), {_pass_sql().format(k=key)}"""


@query("m06_binned", compose("with " + binned_sql("""select sector, p_tail s, case when sector in ('1-URGENT','3-MEDIUM') then 1-adverse_20 when sector='2-HIGH' and p_tail>0.3::double and p_tail<0.6::double then 0 else adverse_20 end y
    from scored""", "sector") + f" select sector, {', '.join(rd(f'e{i}') + f' edge{i}' for i in (1, 2, 3))}, {', '.join(rd(f'p{i}') + f' prob{i}' for i in range(4))} from b3", "scored"))
def _(spark, d):
    s = F.col("sector")
    y = F.when(s.isin("1-URGENT", "3-MEDIUM"), 1 - F.col("adverse_20")).when(
        (s == "2-HIGH") & (F.col("p_tail") > 0.3) & (F.col("p_tail") < 0.6), 0).otherwise(F.col("adverse_20"))
    m = K.fit_binned(fx.scored(spark, d).withColumn("y", y), "p_tail", "y", "sector")
    return tidy(m.select("sector", *[F.col("edges")[i].alias(f"edge{i + 1}") for i in range(3)], *[F.col("probs")[i].alias(f"prob{i}") for i in range(4)]))


_PROB = "case (p_tail>=e1)::int+(p_tail>=e2)::int+(p_tail>=e3)::int when 0 then p0 when 1 then p1 when 2 then p2 else p3 end"


@query("m13_apply_calibrator", compose("with " + binned_sql("select 0 g, p_tail s, adverse_20 y from scored where yr<=1998", "g") + f" select row_id, {rd(_PROB)} p from scored, b3 where yr>1998", "scored"))
def _(spark, d):
    s = fx.scored(spark, d).withColumn("g", F.lit(0))
    return tidy(K.fit_apply("binned", s.where("yr <= 1998"), s.where("yr > 1998"), "p_tail", "adverse_20", "g").select("row_id", "p"))


@query("m08_oof_binned", compose("with bl as (select *, ntile(4) over (order by asof_date,row_id)-1 block from scored), " + binned_sql(
    "select k, p_tail s, adverse_20 y from bl join (values (1),(2),(3)) f(k) on block<k", "k") + f" select row_id, k::int fold, {rd(_PROB)} p from bl join b3 on block=k", "scored"))
def _(spark, d):
    s = fx.scored(spark, d).select("row_id", "asof_date", "p_tail", "adverse_20")
    return tidy(K.oof_calibrated(s, "p_tail", "adverse_20", ORDER, methods=("binned",)).select("row_id", "fold", "p"))


def oof_all(spark, d):
    s = fx.scored(spark, d).select("row_id", "asof_date", "p_tail", "adverse_20")
    return shared(spark, d, "oof_all", lambda: K.oof_calibrated(s, "p_tail", "adverse_20", ORDER))


@query("m08_oof_all_methods")
def _(spark, d):
    return tidy(oof_all(spark, d).select("row_id", "fold", "method", "p"))


@query("m09_select_calibrator")
def _(spark, d):
    skills = K.skill_by_method(oof_all(spark, d), "adverse_20")
    return tidy(skills.join(F.broadcast(K.best_method(skills))))  # one row


@query("m10_holdout_selection")
def _(spark, d):
    s = fx.scored(spark, d)
    return tidy(K.holdout_skills(s.where("yr <= 1998"), s.where("yr > 1998"), "p_tail", "adverse_20"))


@query("m11_hardened_selection")
def _(spark, d):
    return tidy(K.hardened_selection(fx.scored(spark, d), "p_tail", "adverse_20", ORDER))


@query("m12_bootstrap_interval")
def _(spark, d):
    return tidy(K.bootstrap_interval(fx.scored(spark, d), "p_tail", "adverse_20", ORDER, "isotonic"))


# ---- committee ---------------------------------------------------------------------------------------------

RIVER_FEATURES = [f"river_{f}" for f in vocab.DAILY_FEATURES]


def river(spark, d, features):
    return E.river_rows(snapshots(spark, d), list(features)).withColumn("fit", F.lit(0).cast("bigint"))


_Z = ", ".join(f"(r.{f}-m.{f}_m)/case when m.{f}_s>0 then m.{f}_s else 1 end z{i}" for i, f in enumerate(RIVER_FEATURES))
_KNN = f"""with m as (select {', '.join(f'avg({f}) {f}_m, stddev_pop({f}) {f}_s' for f in RIVER_FEATURES)} from river where year(asof_date)<=1998),
    z as (select r.symbol, year(r.asof_date)<=1998 tr, r.risk_severity y, {_Z} from river r, m),
    p as (select t.symbol, a.symbol nid, a.y, round(sqrt({'+'.join(f'(t.z{i}-a.z{i})*(t.z{i}-a.z{i})' for i in range(len(RIVER_FEATURES)))}),10) dist
          from z t join z a on not t.tr and a.tr),
    k as (select *, row_number() over (partition by symbol order by dist, nid) rn from p)"""


def knn(spark, d):
    rows = river(spark, d, RIVER_FEATURES)
    params = CM.fit_ridge(rows.where("yr <= 1998"), len(RIVER_FEATURES))
    train = CM.scale_rows(rows.where("yr <= 1998"), params)
    return CM.nearest_targets(train, CM.scale_rows(CM.dealt(rows.where("yr > 1998")), params, ()), 7)


@query("m02_knn", compose(_KNN + f" select symbol, {rd('avg(y)')} knn from k where rn<=7 group by 1", "river"))
def _(spark, d):
    return tidy(knn(spark, d).select(F.col("row_id").alias("symbol"), "knn"))


@query("j12_neighbour_join", compose(_KNN + f" select symbol, {rd('avg(y)')} knn from k where rn<=7 group by 1", "river"))
def _(spark, d):
    return tidy(knn(spark, d).select(F.col("row_id").alias("symbol"), "knn"))


@query("t04_top_k_mean", compose(_KNN + f" select symbol, {rd('avg(y)')} knn from k where rn<=3 group by 1", "river"))
def _(spark, d):
    rows = river(spark, d, RIVER_FEATURES)
    params = CM.fit_ridge(rows.where("yr <= 1998"), len(RIVER_FEATURES))
    train = CM.scale_rows(rows.where("yr <= 1998"), params)
    out = CM.nearest_targets(train, CM.scale_rows(CM.dealt(rows.where("yr > 1998")), params, ()), 3)
    return tidy(out.select(F.col("row_id").alias("symbol"), "knn"))


DRAWN = 64


@query("m02_knn_drawn", compose(_KNN.replace("k as (", f"""dr as (select symbol nid from z where tr order by md5(symbol), symbol limit {DRAWN}),
    k as (""").replace("rn from p)", "rn from p join dr using (nid))") + f" select symbol, {rd('avg(y)')} knn from k where rn<=7 group by 1", "river"))
def _(spark, d):
    """The neighbour model on its draw: with a bound below the number of labelled rows, SQL restates which rows it keeps."""
    rows = river(spark, d, RIVER_FEATURES)
    params = CM.fit_ridge(rows.where("yr <= 1998"), len(RIVER_FEATURES))
    train = CM.scale_rows(rows.where("yr <= 1998"), params)
    out = CM.nearest_targets(train, CM.scale_rows(CM.dealt(rows.where("yr > 1998")), params, ()), 7, fit_rows=DRAWN)
    return tidy(out.select(F.col("row_id").alias("symbol"), "knn"))


@query("m01_ridge", compose(f"""with m as (select avg(river_realized_vol) a, stddev_pop(river_realized_vol) s, avg(river_cum_return) b, stddev_pop(river_cum_return) t,
      avg(risk_severity) y from river where year(asof_date)<=1998),
    g as (select sum(u*u)+1000 g11, sum(u*v) g12, sum(v*v)+1000 g22, sum(u*yc) c1, sum(v*yc) c2 from
      (select (river_realized_vol-a)/s u, (river_cum_return-b)/t v, risk_severity-y yc from river, m where year(asof_date)<=1998)),
    w as (select (c1*g22-c2*g12)/(g11*g22-g12*g12) w1, (c2*g11-c1*g12)/(g11*g22-g12*g12) w2 from g)
    select symbol, {rd('y+w1*(river_realized_vol-a)/s+w2*(river_cum_return-b)/t')} ridge from river, m, w where year(asof_date)>1998""", "river"))
def _(spark, d):
    rows = river(spark, d, ["river_realized_vol", "river_cum_return"])
    params = CM.fit_ridge(rows.where("yr <= 1998"), 2)
    return tidy(CM.apply_ridge(rows.where("yr > 1998"), params).select(F.col("row_id").alias("symbol"), "ridge"))


def all_river(spark, d, fitted_until=None):
    """(rows, number of features): labelled river rows on every column that holds no null in those that fit."""
    s = snapshots(spark, d)
    labelled = s.where((F.col("street") == "RIVER") & F.col("risk_severity").isNotNull())
    features = E.feature_columns(labelled if fitted_until is None else labelled.where(F.year("asof_date") <= fitted_until))
    return E.river_rows(s, features), len(features)


@query("m03_committee")
def _(spark, d):
    rows, width = all_river(spark, d, 1998)
    out = E.committee_on_split(rows.withColumn("held", F.col("yr") > 1998), F.col("yr") <= 1998, width)
    return tidy(out.select("row_id", "held", "ridge", "knn", "score"))


def oof_river(spark, d):
    def build():
        rows, width = all_river(spark, d)
        return E.oof_scores(materialise(rows, "river"), width)

    return shared(spark, d, "oof_river", build)


@query("m07_oof_scores")
def _(spark, d):
    return tidy(oof_river(spark, d).select("row_id", "fold_id", "score", "y", "adverse_20"))


# ---- evaluation ----------------------------------------------------------------------------------------------

PLAN = E.FoldPlan(folds=FOLDS)


def all_features():
    from firstprint.operators.snapshots import STREET_FEATURES

    street = [f"{s.lower()}_{f}" for s in vocab.STREETS for f in STREET_FEATURES]
    return [*vocab.PREFLOP_FEATURES, *street, *vocab.METADATA_FEATURES, *E.ONE_HOTS]


def ablation_rows(spark, d):
    return shared(spark, d, "ablation", lambda: E.evaluate_folds_detailed(
        augmented(spark, d), PLAN, all_features(), E.VARIANTS))


def full_rows(spark, d):
    return ablation_rows(spark, d).where(F.col("variant") == "A_full")


@query("e07_champion_fold_metrics")
def _(spark, d):
    return tidy(E.fold_metrics(full_rows(spark, d)))


@query("e08_fold_predictions")
def _(spark, d):
    plan = E.FoldPlan(folds=FOLDS, constraints=E.FALSIFICATION)
    return tidy(E.evaluate_folds_detailed(augmented(spark, d), plan, all_features()))


@query("e09_stability_gates")
def _(spark, d):
    return M.acceptance_gates(E.fold_metrics(full_rows(spark, d)), ["variant"])


@query("e10_ablation")
def _(spark, d):
    return tidy(M.deltas_to_baseline(E.fold_metrics(ablation_rows(spark, d))))


@query("e06_champion_holdout")
def _(spark, d):
    """Every challenger with its gates; the champion with its held-out report. Without a champion nothing is held out."""
    split = temporal_split(snapshots(spark, d), 0.70, 0.30)
    fit_part = F.col("split") != "val"
    labelled = (F.col("street") == "RIVER") & F.col("risk_severity").isNotNull()
    features = E.feature_columns(split.where(labelled & fit_part), exclude=(*vocab.NON_FEATURES, "split"))
    table = materialise(E.challengers(split.where(fit_part), features), "challengers")
    chosen = P.select_champion(table).first()
    report = ["n", "fold_pct", "small_bet_pct", "size_up_pct", "fsr", "detection", "bss"]
    shown = table.select("name", "gate_passed", "fold_min", "small_bet_min", F.col("false_safe_rate").alias("tuned_fsr"))
    if chosen is None:
        return tidy(shown.withColumns({"champion": F.lit(False), **{c: F.lit(None).cast("double") for c in report}}))
    held = E.holdout_evaluation(split, features, chosen.asDict(), fit_part)
    # one row: the champion's report
    held = F.broadcast(held.select(F.col("champion").alias("name"), F.lit(True).alias("champion"), *[F.col(c).cast("double").alias(c) for c in report]))
    return tidy(shown.join(held, "name", "left").withColumn("champion", F.coalesce("champion", F.lit(False))))


@query("e12_shuffle_leakage")
def _(spark, d):
    s = fx.scored(spark, d).select("row_id", "asof_date", "p_tail", "adverse_20")
    return tidy(K.shuffle_test(s, "p_tail", "adverse_20", ORDER))


@query("e13_shift_sentinel")
def _(spark, d):
    s = fx.scored(spark, d).select("row_id", "asof_date", "p_tail", "adverse_20")
    return tidy(E.shift_test(s, "p_tail", "adverse_20", ORDER))


@query("e14_street_baselines", compose(f"""with t as (select street, avg(risk_severity) m, avg(adverse_20) b from snap where risk_severity is not null and year(ipo_date)<=1998 group by 1)
    select street, count(*) n_test, {rd('avg(abs(risk_severity-m))')} constant_mae, {rd('avg((risk_severity-m)*(risk_severity-m))')} constant_mse,
      {rd('avg((adverse_20-b)*(adverse_20-b))')} brier_climatology from snap join t using (street) where risk_severity is not null and year(ipo_date)>1998 group by 1""", "snap"))
def _(spark, d):
    s = snapshots(spark, d)
    early = F.year("ipo_date") <= 1998
    return tidy(E.street_baselines(s.where(early), s.where(~early)))


@query("e14_river_baselines")
def _(spark, d):
    rows, width = all_river(spark, d, 1998)
    return tidy(E.river_baselines(rows, F.col("yr") <= 1998, width))


# ---- the whole fold pipeline on two features, small enough for SQL to restate -----------------------------------

TWO = ["river_realized_vol", "river_cum_return"]
_TWO_FITS = f"""mem as (select symbol, asof_date, sector, risk_severity y, adverse_20, severe_30, {TWO[0]} a, {TWO[1]} b, fold_id, test_year,
      year(asof_date)<=train_end tr from river join {{folds}} on year(asof_date)<=train_end or year(asof_date)=test_year),
    bl as (select *, case when tr then ntile(4) over (partition by fold_id, tr order by asof_date, symbol)-1 else 4 end block from mem),
    tt as (select bl.*, k from bl join (values (1),(2),(3),(4)) ks(k) on tr and block<k),
    st as (select fold_id, k, avg(a) am, stddev_pop(a) sa, avg(b) bm, stddev_pop(b) sb, avg(y) ym from tt group by 1,2),
    zt as (select tt.fold_id, tt.k, symbol, y, y-ym yc, case when sa>1e-12 then (a-am)/sa else 0 end u, case when sb>1e-12 then (b-bm)/sb else 0 end v
           from tt join st on st.fold_id=tt.fold_id and st.k=tt.k),
    gm as (select fold_id, k, sum(u*u)+1000 g1, sum(u*v) g2, sum(v*v)+1000 g3, sum(u*yc) c1, sum(v*yc) c2 from zt group by 1,2),
    qs as (select bl.fold_id, bl.block k, bl.test_year, symbol, sector, adverse_20, severe_30, ym,
             case when sa>1e-12 then (a-am)/sa else 0 end u, case when sb>1e-12 then (b-bm)/sb else 0 end v
           from bl join st on st.fold_id=bl.fold_id and st.k=bl.block),
    rg as (select qs.*, ym+(c1*g3-c2*g2)/(g1*g3-g2*g2)*u+(c2*g1-c1*g2)/(g1*g3-g2*g2)*v ridge from qs join gm on gm.fold_id=qs.fold_id and gm.k=qs.k),
    nn as (select q.fold_id, q.k, q.symbol, z.y, row_number() over (partition by q.fold_id, q.k, q.symbol
             order by round(sqrt((q.u-z.u)*(q.u-z.u)+(q.v-z.v)*(q.v-z.v)),10), z.symbol) rn from qs q join zt z on z.fold_id=q.fold_id and z.k=q.k),
    kn as (select fold_id, k, symbol, avg(y) knn from nn where rn<=7 group by 1,2,3),
    sc as (select rg.*, knn, (ridge+knn)/2 score from rg join kn on kn.fold_id=rg.fold_id and kn.k=rg.k and kn.symbol=rg.symbol)"""
_ONE_FOLD = "(values (0,9999,0)) f(fold_id,train_end,test_year)"
_YEAR_FOLDS = "(values " + ",".join(f"({i},{a},{b})" for i, (a, b) in enumerate(FOLDS)) + ") f(fold_id,train_end,test_year)"


@query("m03_committee_two_features", compose("with " + _TWO_FITS.format(folds="(values (0,1998,1999)) f(fold_id,train_end,test_year)").replace(
    "or year(asof_date)=test_year", "or year(asof_date)>1998") + f" select symbol, {rd('ridge')} ridge, {rd('knn')} knn, {rd('score')} score from sc where k=4", "river"))
def _(spark, d):
    rows = E.river_rows(snapshots(spark, d), TWO)
    out = E.committee_on_split(rows.withColumn("held", F.col("yr") > 1998), F.col("yr") <= 1998, 2).where("held")
    return tidy(out.select(F.col("row_id").alias("symbol"), "ridge", "knn", "score"))


@query("m07_oof_two_features", compose("with " + _TWO_FITS.format(folds=_ONE_FOLD) + f" select symbol, k::int fold_id, {rd('score')} score, adverse_20 from sc where k<4", "river"))
def _(spark, d):
    rows = materialise(E.river_rows(snapshots(spark, d), TWO), "river")
    return tidy(E.oof_scores(rows, 2).select(F.col("row_id").alias("symbol"), "fold_id", "score", "adverse_20"))


_TWO_POLICY = _TWO_FITS.format(folds=_YEAR_FOLDS) + """,
    lv as (select fold_id, score s, count(*)::double n, sum(adverse_20)::double pos, row_number() over (partition by fold_id order by score) i from sc where k<4 group by 1,2),
    cum as (select fold_id, i, s, n, pos, sum(n) over (partition by fold_id order by i) cn, sum(pos) over (partition by fold_id order by i) cp from lv),
    ab as (select a.fold_id, a.i a, b.i b, b.s, (b.cp-a.cp+a.pos)/(b.cn-a.cn+a.n) v from cum a join cum b on b.fold_id=a.fold_id and b.i>=a.i),
    mn as (select *, min(v) over (partition by fold_id, a order by b desc rows unbounded preceding) mv from ab),
    iso as (select fold_id, s, max(mv) p from mn group by 1,2),
    lo as (select sc.fold_id, sc.k, symbol, max(s) s, arg_max(p,s) p from sc join iso on iso.fold_id=sc.fold_id and s<=score group by 1,2,3),
    hi as (select sc.fold_id, sc.k, symbol, min(s) s, arg_min(p,s) p from sc join iso on iso.fold_id=sc.fold_id and s>=score group by 1,2,3),
    pt as (select sc.*, case when lo.p is null then hi.p when hi.p is null then lo.p when hi.s=lo.s or hi.p=lo.p then lo.p
             else lo.p+(hi.p-lo.p)*(score-lo.s)/(hi.s-lo.s) end p_tail
           from sc left join lo on lo.fold_id=sc.fold_id and lo.k=sc.k and lo.symbol=sc.symbol left join hi on hi.fold_id=sc.fold_id and hi.k=sc.k and hi.symbol=sc.symbol)"""
_TWO_BEST = best_sql("select fold_id, p_tail p, severe_30, adverse_20 from pt where k<4", _OK.format(fsr=0.03, sb=0.12), "fold_id").strip()[5:]
_TWO_TEST = f"""acts as (select pt.*, fin.fold_min, fin.small_bet_min, fin.false_safe_rate oof_fsr,
      case when p_tail>=fin.fold_min then 'FOLD' when p_tail>=fin.small_bet_min then 'SMALL_BET' else 'SIZE_UP' end as action from pt join fin using (fold_id) where k=4)"""


@query("e08_predictions_two_features", compose(f"with {_TWO_POLICY}, {_TWO_BEST}, {_TWO_TEST} select fold_id, test_year, symbol, {rd('score')} score, {rd('p_tail')} p_tail, action from acts", "river"))
def _(spark, d):
    return tidy(two_feature_rows(spark, d).select("fold_id", "test_year", F.col("row_id").alias("symbol"), "score", "p_tail", "action"))


def two_feature_rows(spark, d):
    return shared(spark, d, "two", lambda: E.evaluate_folds_detailed(snapshots(spark, d), PLAN, TWO, {"two": []}))


@query("e07_metrics_two_features", compose(f"""with {_TWO_POLICY}, {_TWO_BEST}, {_TWO_TEST} select fold_id, test_year, {rd('fold_min')} fold_min, {rd('small_bet_min')} small_bet_min,
    {rd('oof_fsr')} oof_fsr, {_MIX}, {_FSR} fsr, {_DET} detection, {rd(f'case when {_CLIMO}>0 then 1-{_BRIER}/({_CLIMO}) else 0 end')} bss from acts group by 1,2,3,4,5""", "river"))
def _(spark, d):
    return tidy(E.fold_metrics(two_feature_rows(spark, d)).select(
        "fold_id", "test_year", "fold_min", "small_bet_min", "oof_fsr", "n", "fold_pct", "small_bet_pct", "size_up_pct", "fsr", "detection", "bss"))


@query("e09_gates_two_features", compose(f"""with {_TWO_POLICY}, {_TWO_BEST}, {_TWO_TEST},
    f as (select fold_id, coalesce(count(*) filter (where severe_30=1 and action='SIZE_UP')/nullif(sum(severe_30),0)::double,0) fsr,
      case when {_CLIMO}>0 then 1-{_BRIER}/({_CLIMO}) else 0 end bss, count(*) filter (where action='SMALL_BET')/count(*)::double sb from acts group by 1)
    select quantile_cont(fsr,0.5)<=0.1::double med_fsr_pass, max(fsr)<=0.15::double worst_fsr_pass, quantile_cont(bss,0.5)>0 med_bss_pass, quantile_cont(sb,0.5)>=0.1::double med_small_pass,
      quantile_cont(fsr,0.5)<=0.1::double and max(fsr)<=0.15::double and quantile_cont(bss,0.5)>0 and quantile_cont(sb,0.5)>=0.1::double all_pass from f""", "river"))
def _(spark, d):
    return M.acceptance_gates(E.fold_metrics(two_feature_rows(spark, d)))


@query("s13_run_manifest")
def _(spark, d):
    return tidy(E.full_run(snapshots(spark, d))).withColumn(
        "feature_cols", F.concat_ws(",", "feature_cols"))
