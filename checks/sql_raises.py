"""SQL of the private-raise queries: flat deal and founder tables, one CASE per signal."""

from __future__ import annotations

from ebbline import fixtures_sql as fx

AS_OF = "date '2026-07-01'"


def su(x: str, a: float, b: float) -> str:
    """Linear map of [a, b] onto [-1, 1], clamped; NULL stays NULL."""
    return f"(case when ({x}) is not null then greatest(-1e0,least(1e0,2e0*(({x})-({a}e0))/({b}e0-({a}e0))-1e0)) end)"


FND = """fa as (select deal_id, count(*) as n, max(domain_years) as yrs, count(*) filter (where prior_exit) as exits, count(*) filter (where prior_founder) as prior,
  count(prior_founder) as prior_known, count(full_time) as ft_known, count(*) filter (where full_time) as ft, sum(insolvency_count) as ins,
  first(name order by pos) filter (where insolvency_count>=2) as first_repeat from fo group by deal_id),
dx as materialized (select dl.*, coalesce(n,0) as nf, yrs, coalesce(exits,0) as exits, coalesce(prior,0) as prior, coalesce(prior_known,0) as prior_known, ft_known, ft, coalesce(ins,0) as ins, first_repeat,
  case when revenue_ltm>0 then pre_money/revenue_ltm end as rm,
  (AS_OF-incorporated_on)/365.25e0 as age from dl left join fa using (deal_id))""".replace("AS_OF", AS_OF)

# pillar, position, code, value, weight, provenance, condition for the signal to exist
SIGNALS = [
    ("team", "'team.absent'", "cast(null as double)", 3, "'registry'", "nf=0"),
    ("team", "'team.domain_years'", su("case when yrs is not null then least(yrs,20e0) end", 1, 12), 2.5, "'founder'", "nf>0"),
    ("team", "case when exits>0 then 'team.prior_exit' when prior>0 then 'team.prior_founder' when prior_known>0 then 'team.first_time' else 'team.prior_founder' end",
     "case when exits>0 then 1e0 when prior>0 then 0.45e0 when prior_known>0 then -0.2e0 end", 2, "'registry'", "nf>0"),
    ("team", "'team.full_time'", su("ft/nullif(ft_known,0)::double", 0.3, 1), 1.5, "'founder'", "nf>0"),
    ("team", "'team.size'", "case when nf=1 then -0.5e0 when nf<=3 then 0.6e0 else 0.2e0 end", 1, "'platform'", "nf>0"),
    ("team", "'team.insolvency'", "greatest(-1e0,-0.4e0*ins)", 2, "'registry'", "nf>0 and ins>0"),
    ("traction", "'traction.revenue'", su("case when revenue_ltm is not null then least(revenue_ltm/(case stage when 'pre_seed' then 50000e0 when 'series_a' then 1500000e0 when 'growth' then 5000000e0 else 300000e0 end),3e0) end", 0.1, 1.5), 2.5, "'founder'", "true"),
    ("traction", "'traction.growth'", su("revenue_growth_pct", -10, 150), 2, "'founder'", "true"),
    ("traction", "'traction.margin'", su("gross_margin_pct", 15, 75), 2, "'founder'", "true"),
    ("traction", "'traction.runway'", su("runway_months", 3, 18), 1.5, "'founder'", "true"),
    ("traction", "'traction.ltv_cac'", su("ltv_cac", 0.8, 4), 1.5, "'founder'", "true"),
    ("traction", "'traction.churn'", su("-churn_pct_monthly", -8, -1), 1.5, "'founder'", "true"),
    ("terms", "'terms.revenue_multiple'", su("-rm", -25, -3), 3, "'platform'", "true"),
    ("terms", "'terms.share_class'", "case when share_class in ('ordinary','preferred','a_shares') then 0.6e0 when share_class<>'unknown' then -0.6e0 end", 2, "'platform'", "true"),
    ("terms", "'terms.rights'", "case when coalesce(has_preemption_rights,has_information_rights,has_voting_rights) is not null then " +
     su("(coalesce(has_preemption_rights,false)::int+coalesce(has_information_rights,false)::int+coalesce(has_voting_rights,false)::int)", 0, 3) + " end", 2, "'platform'", "true"),
    ("terms", "'terms.retained_equity'", su("founder_retained_pct", 35, 80), 1.5, "'platform'", "true"),
    ("terms", "'terms.structure'", "case when nominee_structure then 0.2e0 when not nominee_structure then 0.5e0 end", 1, "'platform'", "true"),
    ("integrity", "'integrity.no_registry'", "cast(null as double)", 4, "'registry'", "not has_registry"),
    ("integrity", "'integrity.filing_health'", "case filing_health when 'current' then 0.9e0 when 'unknown' then -0.3e0 else -1e0 end", 3, "'registry'", "has_registry"),
    ("integrity", "'integrity.charges'", "case when outstanding_charges=0 then 0.6e0 else greatest(-1e0,-0.35e0*outstanding_charges) end", 2.5, "'registry'", "has_registry"),
    ("integrity", "'integrity.age'", su("age", 0.5, 6), 1, "'registry'", "has_registry and incorporated_on is not null"),
    ("integrity", "'integrity.directors'", "case when active_directors=0 then -1e0 else " + su("active_directors", 1, 4) + " end", 1, "'registry'", "has_registry"),
    ("smart_money", "'smart.lead'", "case when has_professional_lead then 0.9e0 when not has_professional_lead then -0.4e0 end", 3, "'platform'", "true"),
    ("smart_money", "case when n_co_investors>0 then 'smart.co_investors' else 'smart.prior_funding' end", "case when n_co_investors>0 then " + su("n_co_investors", 0, 4) + " end", 1.5,
     "case when n_co_investors>0 then 'platform' else 'registry' end", "true"),
    ("market", "'market.sector'", "0e0", 2, "'manual'", "true"),
]
PILLARS = {"team": 20, "traction": 20, "terms": 20, "integrity": 16, "smart_money": 14, "market": 10}
ORDER = {p: i for i, p in enumerate(PILLARS)}

_legs = " union all ".join(
    f"select deal_id, '{p}' as pillar, {ORDER[p]} as pp, {PILLARS[p]}e0 as pw, {i} as sp, {code} as code, {value} as raw, {float(w)}e0 as weight, {prov} as provenance from dx where {cond}"
    for i, (p, code, value, w, prov, cond) in enumerate(SIGNALS)
)
EVID = f"""dl as ({fx.DEALS}), fo as ({fx.FOUNDERS}), {FND},
sg as materialized (select *, coalesce(raw,-0.55e0) as value, raw is null as missing from ({_legs})),
pls as (select deal_id, pillar, max(pw) as weight, greatest(0e0,least(100e0,(sum(value*weight)/sum(weight)+1)*50)) as score,
  sum(case when missing then weight else 0 end)/sum(weight) as opacity from sg group by deal_id, pillar),
ds as materialized (select deal_id, sum(score*weight)/sum(weight) as es, sum(opacity*weight)/sum(weight) as op from pls group by deal_id)"""

_VETO = [
    ("no_advance_assurance", True, "tax_wrapper='NONE' and country='UK'"),
    ("unwrapped_jurisdiction", False, "tax_wrapper='NONE' and country<>'UK'"),
    ("accounts_overdue", True, "has_registry and (filing_health='overdue' or accounts_overdue or confirmation_overdue)"),
    ("strike_off_proposed", True, "has_registry and filing_health='strike_off_proposed'"),
    ("secured_debt_ahead", False, "has_registry and outstanding_charges>0"),
    ("director_insolvency_pattern", True, "first_repeat is not null"),
    ("extreme_valuation", True, "rm>30 and sector not in ('deeptech','biotech')"),
    ("no_rights_at_high_price", True, "rm>15 and share_class in ('ordinary_non_voting','b_shares') and has_preemption_rights=false and has_information_rights=false"),
    ("insufficient_disclosure", True, "op>=0.65"),
]
VETO = EVID + ", vt as (" + " union all ".join(
    f"select deal_id, '{c}' as code, {str(h).lower()} as hard from dx join ds using (deal_id) where {cond}" for c, h, cond in _VETO
) + """), va as (select deal_id, count(*) as nv, bool_or(hard and code<>'insufficient_disclosure') as rejects, bool_or(code='insufficient_disclosure') as blind from vt group by deal_id),
vd as materialized (select dx.deal_id, case when rejects then 'REJECTED' when blind then 'INSUFFICIENT_DATA' when coalesce(nv,0)>0 or op>=0.4 then 'ELIGIBLE_WITH_FLAGS' else 'ELIGIBLE' end as verdict,
  floor(es*10+0.5e0)/10 as evidence_score, floor(op*1000+0.5e0)/1000 as opacity_index from dx join ds using (deal_id) left join va using (deal_id))"""

HINTED = "code in ('traction.churn','traction.growth','traction.margin','traction.ltv_cac','traction.revenue','traction.runway','terms.revenue_multiple','terms.rights','terms.share_class','terms.retained_equity','terms.structure','smart.lead','smart.prior_funding','integrity.no_registry','team.domain_years','team.prior_founder','team.full_time','team.absent')"


def net(gross: str, wrapper: str, fee: str = "0e0", carry: str = "0e0", liability: str = "true") -> str:
    relief = f"(case when {liability} then case {wrapper} when 'SEIS' then 0.5e0 when 'EIS' then 0.3e0 else 0e0 end else 0e0 end)"
    cost = f"(1e0+{fee}-{relief})"
    pr = f"({gross}-greatest({gross}-1e0,0e0)*{carry})"
    return f"(case when {pr}>={cost} then {pr}/{cost} else ({pr}+(case when {wrapper}<>'NONE' then ({cost}-{pr})*0.45e0 else 0e0 end))/{cost} end)"


def fee(p: str) -> str:
    return f"(case lower({p}) when 'crowdcube' then 0.015e0 when 'wefunder' then 0.02e0 when 'startengine' then 0.035e0 else 0e0 end)"


def carry(p: str) -> str:
    return f"(case when lower({p}) in ('seedrs','republic') then 0.075e0 else 0e0 end)"


def relief(w: str, liability: str = "true") -> str:
    return f"(case when {liability} then case {w} when 'SEIS' then 0.5e0 when 'EIS' then 0.3e0 else 0e0 end else 0e0 end)"


def hurdle(years: str, w: str, p: str, premium: str = "0e0", liability: str = "true") -> str:
    return f"(((1e0+{fee(p)}-{relief(w, liability)})*pow(1e0+0.1e0+{premium},{years})-{carry(p)})/(1e0-{carry(p)}))"


DL = f"dl as ({fx.DEALS})"
OUT = f"oc as materialized ({fx.OUTCOMES})"
SEGS = "seg as (select concat('deal:', cast(c_custkey as varchar)) as deal_id, c_mktsegment as dist_id from customer)"
SENS = OUT + """, tg as (select oc.*, tp from oc, (values (0.02e0),(0.015e0),(0.012e0),(0.01e0),(0.008e0),(0.007e0),(0.005e0),(0.003e0),(0e0)) g(tp)),
te as (select dist_id, tp, max(multiple) as hi, min(multiple) as lo, arg_max(p, multiple)-tp as delta from tg group by dist_id, tp),
tm as (select tg.dist_id, tg.tp, multiple, case when multiple=hi then tg.tp when multiple=lo then greatest(0e0,p+delta) else p end as q from tg join te on te.dist_id=tg.dist_id and te.tp=tg.tp),
tn as (select *, q/sum(q) over (partition by dist_id, tp) as p from tm),
sens as (select dist_id, tp as tail_p, sum(multiple*p) as expected_gross, sum(p*NET) as expected_net, sum(p*NET)/pow(1.1e0,8) as edge from tn group by dist_id, tp)""".replace("NET", net("multiple", "'SEIS'"))
GRID = (1, 2, 3, 5, 8, 10, 15, 20, 30, 50, 75, 100)
ODDS = f"""po as ({fx.POSITIONS}), pk as (select *, {net('multiple', "'SEIS'")} as nm, row_number() over (partition by dist_id, investor order by taken, seq) as k, count(*) over (partition by dist_id, investor) as held from po),
tr as materialized (select dist_id, n as positions, investor, sum(nm)/n as m, bool_or(multiple>=10) as t from pk join (values {','.join(f'({n})' for n in GRID)}) g(n) on k<=n and n<=held group by dist_id, n, investor),
od as materialized (select dist_id, positions, count(*) as investors, avg(m) as mean_multiple, avg(case when m>=pow(1.1e0,8) then 1e0 else 0e0 end) as p_beat_index, avg(case when m<1 then 1e0 else 0e0 end) as p_below_capital,
  avg(case when t then 1e0 else 0e0 end) as p_any_tail, list_sort(list(m)) as ms from tr group by dist_id, positions)"""

# name -> (ctes, columns, source, digits)
RAISES = {
    "evidence_signals": (EVID, "deal_id, pillar, code, value:r, weight:r, missing, provenance", "sg", 6),
    "evidence_pillars": (EVID, "deal_id, pillar, score:r, opacity:r, weight:r", "pls", 6),
    "evidence_scores": (VETO, "deal_id, evidence_score:r, opacity_index:r", "vd", 6),
    "founder_rollups": (EVID, "deal_id, founders:i=nf, best_years:r=yrs, exits:i, insolvencies:i=ins, first_repeat", "dx", 4),
    "revenue_multiples": (EVID, "deal_id, revenue_multiple:r=rm", "dx", 4),
    "deal_vetoes": (VETO, "deal_id, code, hard", "vt", 4),
    "deal_verdicts": (VETO, "deal_id, verdict, evidence_score:r, opacity_index:r", "vd", 6),
    "assessment_order": (VETO, "deal_id, verdict, opacity_index:r",
                         "(select * from vd order by case verdict when 'ELIGIBLE' then 0 when 'ELIGIBLE_WITH_FLAGS' then 1 when 'INSUFFICIENT_DATA' then 2 else 3 end, opacity_index, deal_id)", 6),
    "network_ratings": (DL + """, nw as (select deal_id, case when has_professional_lead is not null then 30e0 else 0e0 end as a1, case when has_professional_lead then 30e0 else 0e0 end as s1,
  case when n_co_investors>0 then 20e0 else 0e0 end as a2, case when n_co_investors>0 then 20e0*least(1e0,n_co_investors/3e0) else 0e0 end as s2,
  case when syndicate_access is not null then 18e0 else 0e0 end as a3, case when syndicate_access then 18e0 else 0e0 end as s3,
  case when founder_accessible is not null then 12e0 else 0e0 end as a4, case when founder_accessible then 12e0 else 0e0 end as s4,
  case when sector_adjacency is not null then 12e0 else 0e0 end as a5, case when sector_adjacency is not null then 12e0*greatest(0e0,least(1e0,sector_adjacency)) else 0e0 end as s5,
  case when investor_count is not null then 8e0 else 0e0 end as a6, case when investor_count>2000 then 8e0*0.15e0 when investor_count>500 then 8e0*0.45e0 when investor_count is not null then 8e0*0.9e0 else 0e0 end as s6 from dl),
 nx as (select deal_id, a1+a2+a3+a4+a5+a6 as seen, coalesce((s1+s2+s3+s4+s5+s6)/nullif(a1+a2+a3+a4+a5+a6,0)*100,0) as lv from nw)""",
                        "deal_id, network_band=case when seen/100e0<0.3e0 then 'NONE' when lv>=65 then 'HIGH' when lv>=40 then 'MODERATE' else 'LOW' end, network_score:i=floor(lv+0.5e0)", "nx", 4),
    "research_tasks": (EVID, "deal_id, rank:i, code, task='undisclosed '||replace(split_part(code,'.',1),'_',' ')||': '||replace(split_part(code,'.',2),'_',' ')",
                       f"(select deal_id, code, row_number() over (partition by deal_id order by weight*pw desc, pp, sp) as rank from sg where missing and {HINTED})", 4),
    "deal_hurdles": (DL, f"deal_id, index_multiple:r=pow(1.1e0,8), hurdle_multiple:r={hurdle('8', 'tax_wrapper', 'platform')}, breakeven_multiple:r={hurdle('0', 'tax_wrapper', 'platform')}, "
                     + f"net_cost_fraction:r=1e0-{relief('tax_wrapper')}, downside_multiple:r={net('0e0', 'tax_wrapper', fee('platform'), carry('platform'))}, notes=case when tax_wrapper='NONE' then 'no_relief' else '' end", "dl", 4),
    "net_multiples": (OUT + ", nm as (select oc.*, w.wrapper, q.platform from oc, (values ('SEIS'),('EIS'),('NONE')) w(wrapper), (values ('Crowdcube'),('seedrs'),('startengine'),('none')) q(platform)), nv as (select *, "
                      + net("multiple", "wrapper", fee("platform"), carry("platform")) + " as net from nm)", "dist_id, multiple:r, wrapper, platform, net:r", "nv", 4),
    "hurdle_scenarios": (DL + ", hs as (select platform, wrapper, years, liability, premium from dl, (values ('SEIS'),('EIS'),('NONE')) a(wrapper), (values (2e0),(8e0)) b(years), (values (true),(false)) c(liability), (values (0e0),(0.04e0)) d(premium)), hv as (select *, "
                         + hurdle("years", "wrapper", "platform", "premium", "liability") + " as h, " + hurdle("0", "wrapper", "platform", "0e0", "liability") + " as be, "
                         + net("0e0", "wrapper", fee("platform"), carry("platform"), "liability") + " as dn, 1e0-" + relief("wrapper", "liability") + " as nc, pow(1.1e0,years) as im from hs)",
                         "platform, wrapper, years:r, liability, premium:r, deals:i=count(*), hurdle:r=max(h), breakeven:r=max(be), downside:r=max(dn), net_cost:r=max(nc), index_multiple:r=max(im)",
                         "hv group by platform, wrapper, years, liability, premium", 4),
    "outcome_expectations": (OUT + ", ne as (select *, " + net("multiple", "'SEIS'") + " as nm from oc)",
                             "dist_id, expected_gross:r=sum(multiple*p), expected_net:r=sum(p*nm), p_at_or_below_0:r=sum(case when multiple<=0 then p else 0 end), p_at_or_below_1:r=sum(case when multiple<=1 then p else 0 end), edge:r=sum(p*nm)/pow(1.1e0,8)", "ne group by dist_id", 4),
    "retailed_outcomes": (OUT + """, e as (select dist_id, max(multiple) as hi, min(multiple) as lo, arg_max(p, multiple)-0.005e0 as delta from oc group by dist_id),
 m as (select dist_id, multiple, case when multiple=hi then 0.005e0 when multiple=lo then greatest(0e0,p+delta) else p end as q from oc join e using (dist_id))""", "dist_id, multiple:r, p:r=q/sum(q) over (partition by dist_id)", "m", 6),
    "tail_sensitivity": (SENS, "dist_id, tail_p:r, expected_gross:r, expected_net:r, edge:r, label=case when edge>=1.25 then 'worth doing' when edge>=1 then 'beats index' else 'loses to index' end", "sens", 4),
    "flip_points": (SENS, "dist_id, flip_at:r=max(case when edge<1.25 then tail_p end), last_passing:r=min(case when edge>=1.25 then tail_p end)", "sens group by dist_id", 4),
    "tilted_outcomes": (VETO + "," + OUT + "," + SEGS + ", tw as (select vd.deal_id, multiple, p*exp(0.35e0*greatest(-1e0,least(1e0,(evidence_score-50)/50e0))*ln(1+multiple)) as w from vd join seg using (deal_id) join oc using (dist_id)), tx as (select deal_id, multiple, w/sum(w) over (partition by deal_id) as p from tw), ty as (select *, "
                        + net("multiple", "'SEIS'") + " as nm from tx)", "deal_id, expected_gross:r=sum(multiple*p), expected_net:r=sum(p*nm), p_at_or_below_0:r=sum(case when multiple<=0 then p else 0 end)", "ty group by deal_id", 4),
    "gate_sweep": (VETO + "," + OUT + "," + SEGS + ", gw as (select vd.deal_id, evidence_score, strength, multiple, p*exp(strength*greatest(-1e0,least(1e0,(evidence_score-50)/50e0))*ln(1+multiple)) as w from vd join seg using (deal_id) join oc using (dist_id), (values (0e0),(0.35e0),(0.7e0)) g(strength)), ge as (select deal_id, evidence_score, strength, sum(w*"
                   + net("multiple", "'SEIS'") + ")/sum(w)/pow(1.1e0,8) as edge from gw group by all), gg as (select *, evidence_score>=46 as gate_a, edge>=1.25 as gate_b from ge)",
                   "strength:r, gate_a, gate_b, deals:i=count(*), lowest:r=min(evidence_score), highest:r=max(evidence_score)", "gg where gate_a<>gate_b group by strength, gate_a, gate_b", 4),
    "portfolio_odds": (ODDS, "dist_id, positions:i, investors:i, mean_multiple:r, p_beat_index:r, p_below_capital:r, p_any_tail:r, p10_multiple:r=ms[cast(floor(0.1*(investors-1)) as bigint)+1], median_multiple:r=ms[cast(floor(0.5*(investors-1)) as bigint)+1], p90_multiple:r=ms[cast(floor(0.9*(investors-1)) as bigint)+1], index_multiple:r=pow(1.1e0,8)", "od", 4),
    "any_tail_odds": (OUT + ", pt as (select dist_id, sum(case when multiple>=10 then p else 0 end)/sum(p) as pt from oc group by dist_id)", "dist_id, positions:i, p_any_tail:r=1-pow(1-pt,positions)", f"pt, (values {','.join(f'({n})' for n in GRID)}) g(positions)", 6),
    "deployment_plans": (ODDS + ", dp as (select dist_id, min(case when p_beat_index>=0.5 then positions end) as e, min(case when p_below_capital<=0.25 then positions end) as c from od group by dist_id)",
                         "dist_id, positions_for_even_odds:i=e, positions_for_downside_control:i=c, positions:i=18, capital_at_risk:r=4500e0, notes=concat_ws(',', case when 18<e then 'below_even_odds' end, 'relief_redeployable')", "dp", 4),
}
