"""DuckDB statements for the equity-desk queries, written per as-of window (brute force) where Spark uses segments."""

from __future__ import annotations


def bars(grain: str = "n_name", unit: str = "week") -> str:
    return f"""
cell as (
  select {grain} as ticker, r_name as sector, cast(date_trunc('{unit}', l_shipdate) as date) as d,
         ln(sum(l_extendedprice)/sum(l_quantity)) as lp, sum(l_quantity) as v
  from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
       join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
  group by 1,2,3),
cell_m as (select d, avg(lp) as x from cell group by d),
cell_s as (select sector, d, avg(lp) as x from cell group by sector, d),
zm as (select d, (x-avg(x) over ())/stddev_pop(x) over () as z from cell_m),
zs as (select sector, d, (x-avg(x) over (partition by sector))/stddev_pop(x) over (partition by sector) as z from cell_s),
zc as (select ticker, sector, d, v,
              (lp-avg(lp) over (partition by ticker))/stddev_pop(lp) over (partition by ticker) as z from cell),
zr as (select zc.ticker, zc.sector, zc.d, zc.v, 0.012*zm.z+0.008*zs.z+0.015*zc.z as r
      from zc join zm on zc.d=zm.d join zs on zc.sector=zs.sector and zc.d=zs.d),
zq as (select *, sum(r) over (partition by ticker order by d rows between unbounded preceding and current row) as cr from zr),
bars as materialized (select ticker, sector, d, round(100*exp(cr - r*(1-(dayofyear(d)%10)/10.0)),4) as o, round(100*exp(cr),4) as c,
         cast(v as double) as v from zq),
caps as (select n_name as ticker, sum(greatest(c_acctbal,0))/1000.0 as market_cap_b
         from customer join nation on c_nationkey=n_nationkey group by 1),
edges as (select a.n_name as ticker, b.n_name as peer,
          row_number() over (partition by a.n_name order by b.n_nationkey)-1 as pos
          from nation a join nation b on a.n_regionkey=b.n_regionkey and a.n_nationkey<>b.n_nationkey)"""


W = "partition by ticker order by d"

TECH = f"""
t0 as (select *, row_number() over ({W}) as rn, lag(c) over ({W}) as pc,
        lag(c,5) over ({W}) as c5 from bars),
t1 as (select *, c/pc-1 as ret, case when pc is null then null when pc>0 and c>0 then ln(c/pc) else 0 end as lr,
        coalesce((c/pc-1)*100,0) as dip_pct_day, coalesce((c/c5-1)*100,0) as dip_pct_week,
        case when o>0 and pc>0 then abs(ln(o/pc)) else 0 end as gap, case when o>0 and pc>0 then abs(ln(c/o)) else 0 end as drift,
        case when o>0 then 1 else 0 end as o_ok from t0),
t2 as (select *,
   avg(c) over ({W} rows between 49 preceding and current row) as sma50,
   avg(c) over ({W} rows between 199 preceding and current row) as sma200,
   sum(greatest(c-pc,0)) over ({W} rows between 13 preceding and current row) as up,
   sum(greatest(pc-c,0)) over ({W} rows between 13 preceding and current row) as dn,
   max(c) over ({W} rows between 299 preceding and current row) as high_52w,
   min(c) over ({W} rows between 299 preceding and current row) as low_52w,
   stddev_pop(ret) over ({W} rows between 29 preceding and current row) as sd30,
   avg(abs(ret)) over ({W} rows between 29 preceding and current row) as ab30,
   var_pop(ret) over ({W} rows between 89 preceding and 5 preceding) as vpre,
   list(c) over ({W} rows between 299 preceding and 5 preceding) as prior,
   list(v) over ({W} rows between 299 preceding and current row) as vols,
   sum(gap) over ({W} rows between 4 preceding and current row) as g5,
   sum(drift) over ({W} rows between 4 preceding and current row) as dr5,
   sum(o_ok) over ({W} rows between 4 preceding and current row) as o5
   from t1),
t3 as (select *, list_filter(coalesce(vols,[]), lambda x: x>0) as pv,
   list_sort(list_filter(coalesce(prior,[]), lambda x: x<c*0.995), 'DESC') as below,
   list_filter(coalesce(prior,[]), lambda x: x>c*1.02) as above from t2),
tech as materialized (select ticker, sector, d, o, c, v, rn, pc, ret, lr, dip_pct_day, dip_pct_week, sma50, sma200,
   case when rn<15 then 50.0 when dn=0 then 100.0 else 100-100/(1+up/dn) end as rsi14,
   high_52w, low_52w, (c/high_52w-1)*100 as drawdown_pct,
   case when high_52w=low_52w then 0.5 else (c-low_52w)/(high_52w-low_52w) end as range_position,
   sd30*sqrt(252)*100 as realized_vol_pct, ab30*140 as atr_pct,
   case when vpre>0 then abs(dip_pct_week)/(sqrt(vpre*5)*100) else 0 end as dip_z,
   len(below)>=5 as support_defined,
   case when len(below)>=5 then least(list_avg(list_slice(below,1,greatest(5,cast(floor(len(below)*0.1) as int)))), 0.985*c) else 0.9*c end as support_level,
   case when len(above)>0 then list_min(list_slice(above,greatest(len(above)-119,1),len(above))) else high_52w end as resistance_level,
   case when o5=5 and g5+dr5>0 then g5/(g5+dr5) end as gap_share,
   coalesce(list_avg(list_slice(pv,greatest(len(pv)-89,1),len(pv))),0) as avg_volume,
   case when len(pv)>0 then v/list_avg(list_slice(pv,greatest(len(pv)-89,1),len(pv))) else 1 end as volume_ratio
   from t3)"""


def decomposition(min_history: int, last_only: bool = False, weighted: bool = True) -> str:
    """(t, ticker) rows with technicals, betas, attribution, cause: one explicit window per as-of session."""
    when = "t=n_axis-1" if last_only else f"t>={min_history} and t<=n_axis-2"
    weight = "case when market_cap_b>0 then market_cap_b else 1 end" if weighted else "1.0"
    return f"""
axis as (select d, row_number() over (order by d)-1 as di, count(*) over () as n_axis from (select distinct d from bars)),
bx as (select tech.*, di, n_axis, {weight} as w from tech join axis using (d) join caps using (ticker)),
ends as (select a.di as t, a.d as as_of, a.n_axis, ticker, max(rn) as rn0 from axis a join bx on bx.di<=a.di
         group by all having max(rn)>={min_history}),
ends2 as materialized (select *, count(*) over (partition by t) as members from ends
          where {when} qualify count(*) over (partition by t)>=3),
win as materialized (select e.t, e.ticker, e.members, e.rn0, bx.d, bx.rn, bx.c, bx.lr, bx.w, e.rn0-bx.rn as k
        from ends2 e join bx on bx.ticker=e.ticker and bx.rn between e.rn0-299 and e.rn0),
shared as (select t, d from win group by t, d having count(*)=max(members)),
fr as (select t, d, sum(w*case when p>0 and c>0 then ln(c/p) end)/sum(w) as r from
       (select t, d, ticker, c, w, lag(c) over (partition by t, ticker order by d) as p from win join shared using (t, d)) group by t, d),
fl as (select t, d, sum(coalesce(r,0)) over (partition by t order by d) as lvl from fr),
np as (select e.t, e.ticker, count(*) as n from ends2 e join edges x on x.ticker=e.ticker join ends2 p on p.t=e.t and p.ticker=x.peer group by all),
prow as (select x.ticker, w.t, w.d, x.peer, w.c from win w join edges x on x.peer=w.ticker),
pshared as (select t, ticker, d from prow join np using (t, ticker) group by t, ticker, d having count(*)=max(n)),
pr as (select t, ticker, d, avg(ln(c/p)) as r from
       (select t, ticker, d, peer, c, lag(c) over (partition by t, ticker, peer order by d) as p from prow join pshared using (t, ticker, d)) group by all),
pl as (select t, ticker, d, sum(coalesce(r,0)) over (partition by t, ticker order by d) as lvl from pr),
al as (select win.*, last_value(fl.lvl ignore nulls) over (partition by win.t, win.ticker order by win.d) as ml,
       last_value(pl.lvl ignore nulls) over (partition by win.t, win.ticker order by win.d) as pl
       from win left join fl on fl.t=win.t and fl.d=win.d left join pl on pl.t=win.t and pl.ticker=win.ticker and pl.d=win.d),
rets as materialized (select t, ticker, rn0, rn, k, case when rn>greatest(rn0-299,1) then lr end as rt,
       case when rn>greatest(rn0-299,1) then coalesce(ml-lag(ml) over v,0) end as rm,
       case when rn>greatest(rn0-299,1) then coalesce(pl-lag(pl) over v,0) end as rp from al window v as (partition by t, ticker order by rn)),
s1 as (select t, ticker, least(max(rn0),300) as n, count(rt) filter (where k between 5 and 124) as n_est,
       covar_pop(rt,rm) filter (where k between 5 and 124) as c_tm, var_pop(rm) filter (where k between 5 and 124) as v_m,
       covar_pop(rp,rm) filter (where k between 5 and 124) as c_pm,
       var_pop(rm) filter (where k<120) as hv_m, var_pop(rp) filter (where k<120) as hv_p from rets group by all),
s2 as (select *, case when v_m>1e-18 then c_tm/v_m else 0 end as bm, case when v_m>1e-18 then c_pm/v_m else 0 end as bp,
       coalesce(hv_m,0)>1e-18 as has_m, coalesce(hv_p,0)>1e-18 as has_p from s1),
ex as (select rets.*, s2.bm, case when has_p then rp-bp*rm else 0 end as x from rets join s2 using (t, ticker)),
s3 as (select t, ticker, case when var_pop(x) filter (where k between 5 and 124)>1e-18
       then covar_pop(rt,x) filter (where k between 5 and 124)/var_pop(x) filter (where k between 5 and 124) else 0 end as bs from ex group by all),
rs as (select ex.*, bs, sum(rt-bm*rm-bs*x) over v as r5, count(rt) over v as n5 from ex join s3 using (t, ticker)
       window v as (partition by t, ticker order by rn rows between 4 preceding and current row)),
s4 as (select t, ticker, max(bm) as bm, max(bs) as bs, sum(rt) filter (where k<5) as tl, max(bm)*sum(rm) filter (where k<5) as mlg,
       max(bs)*sum(x) filter (where k<5) as slg, stddev_pop(r5) filter (where k between 5 and 120 and n5=5) as sig from rs group by all),
s5 as (select s4.*, n, n_est, has_m, has_p, tl-mlg-slg as il, case when sig>1e-9 then (tl-mlg-slg)/sig else 0 end as z from s4 join s2 using (t, ticker)),
s6 as (select e.t, e.as_of, s5.*exclude(t), tech.*exclude(ticker, rn), e.rn0,
       (n<35) or (has_m and n_est<30) as short, ((n<35) or (has_m and n_est<30) or not has_m) as blank
       from s5 join ends2 e using (t, ticker) join tech on tech.ticker=s5.ticker and tech.rn=e.rn0),
dec as materialized (select t, as_of, ticker, sector, d, c as price, dip_pct_day, dip_pct_week, volume_ratio, rsi14, sma50, sma200, high_52w, low_52w,
       drawdown_pct, range_position, atr_pct, realized_vol_pct, dip_z, support_level, support_defined, resistance_level, avg_volume,
       case when blank or abs(tl)<=0 then 'UNKNOWN' when abs(mlg+slg)/abs(tl)>=0.7 then (case when abs(mlg)>=abs(slg) then 'MARKET_BETA' else 'SECTOR_ROTATION' end)
            when z<=-2.5 or (gap_share>=0.6 and z<=-1.5) then 'IDIOSYNCRATIC_SHOCK' else 'IDIOSYNCRATIC_NO_NEWS' end as cause,
       case when short then 0 else (exp(tl)-1)*100 end as total_pct, case when blank then 0 else (exp(mlg)-1)*100 end as market_pct,
       case when blank then 0 else (exp(slg)-1)*100 end as sector_pct, case when blank then 0 else (exp(il)-1)*100 end as idio_pct,
       case when blank or tl=0 then 0 else least(1,abs(mlg+slg)/abs(tl)) end as systematic_share,
       case when blank then 1 else bm end as beta_market, case when blank then 0 else bs end as beta_sector,
       case when blank then 0 else z end as residual_z, case when not blank then gap_share end as gap_share,
       case when blank then 'LOW' when n_est>=90 and has_p and gap_share is not null then 'HIGH' when n_est>=60 then 'MODERATE' else 'LOW' end as confidence
       from s6)"""


def sc(x: str, a: float, b: float) -> str:
    return f"greatest(0.0,least(100.0,(({x})-({a}))/(({b})-({a}))*100))"


SIGNAL = f"""
sig0 as (select *, cast(floor(greatest(0,least(100, case cause when 'MARKET_BETA' then 82 when 'SECTOR_ROTATION' then 66
      when 'IDIOSYNCRATIC_NO_NEWS' then 60+greatest(-10,least(12,(1.5-abs(residual_z))*8))
      when 'IDIOSYNCRATIC_SHOCK' then 22-greatest(0,least(15,(abs(residual_z)-2.5)*6)) else 50 end))+0.5) as int) as catalyst_score,
   cast(floor({sc('dip_z', 0.8, 3.5)}*0.45+{sc('volume_ratio', 1, 3.5)}*0.35
      +{sc('abs(dip_pct_day)/greatest(abs(dip_pct_week),0.1)', 0.25, 1)}*0.2+0.5) as int) as dip_character_score,
   cast(floor({sc('-rsi14', -55, -22)}*0.65+(case when support_defined then {sc('-(price-support_level)/price*100', -12, -0.5)} else 0 end)*0.35+0.5) as int) as technical_score
   from dec),
sig as materialized (select *, cast(floor((catalyst_score*0.22e0+dip_character_score*0.18e0+technical_score*0.12e0)/(0.22e0+0.18e0+0.12e0)+0.5e0) as int) as signal_score from sig0)"""


def observations(min_history: int = 200) -> str:
    fwd = ", ".join(
        f"case when price>0 and f{h}.c<>0 then (f{h}.c/price-1)*100 end as fwd_{h}" for h in (5, 20, 60)
    )
    joins = " ".join(f"left join bx f{h} on f{h}.ticker=sig.ticker and f{h}.di=sig.t+{h}" for h in (5, 20, 60))
    return ",".join([bars(), TECH, decomposition(min_history), SIGNAL]) + f""",
obs0 as (select sig.*, {fwd} from sig {joins} where sig.dip_pct_week<0),
obs as materialized (select * from obs0 where fwd_5 is not null or fwd_20 is not null or fwd_60 is not null),
long as (select obs.*exclude(fwd_5,fwd_20,fwd_60), h as horizon, case h when 5 then fwd_5 when 20 then fwd_20 else fwd_60 end as fwd_ret
         from obs, (values (5),(20),(60)) hs(h) where (case h when 5 then fwd_5 when 20 then fwd_20 else fwd_60 end) is not null)"""


SUPPLIER_BARS = """
cell as (select l_suppkey as k, cast(date_trunc('month', l_shipdate) as date) as d, ln(sum(l_extendedprice)/sum(l_quantity)) as lp, cast(sum(l_quantity) as double) as v
  from lineitem group by 1, 2 having not (l_suppkey%10=3 and cast(date_trunc('month', l_shipdate) as date)<date '1993-07-01')
  and not (l_suppkey%10=7 and cast(date_trunc('month', l_shipdate) as date)>date '1997-06-01')),
priced as (select k, d, v, round(exp(lp-avg(lp) over (partition by k))*100.0,4) as c from cell),
bars as materialized (select s_name as ticker, n_name as sector, d, round(c*(month(d)%5+198)/200.0,4) as o, c, v
  from priced join supplier on s_suppkey=k join nation on s_nationkey=n_nationkey),
caps as (select s_name as ticker, greatest(s_acctbal,0)/1000.0 as market_cap_b from supplier),
edges as (select a.s_name as ticker, b.s_name as peer, b.s_suppkey-a.s_suppkey-1 as pos from supplier a join supplier b on b.s_suppkey between a.s_suppkey+1 and a.s_suppkey+3)"""
