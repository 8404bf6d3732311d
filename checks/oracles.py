"""The SQL each query is compared with. Only plain SQL on the driver tables, independent of the Spark plans."""

from __future__ import annotations

from checks import sql_equity as eq
from checks.sql_raises import RAISES
from ebbline import fixtures_sql as fx

MIN_HISTORY = 200
ORACLES: dict[str, str] = {}


def cols(spec: str, digits: int = 4) -> str:
    """``a, b:i, c:r`` -> plain, bigint, rounded. ``c:r=expr`` names an expression."""
    out, depth, start = [], 0, 0
    items = []
    for pos, ch in enumerate(spec + ","):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and depth == 0:
            items.append(spec[start:pos])
            start = pos + 1
    for item in items:
        item, _, expr = item.strip().partition("=")
        name, _, kind = item.partition(":")
        expr = expr or name
        out.append({"i": f"cast({expr} as bigint)", "r": f"round(cast({expr} as double)+1e-9,{digits})+0.0e0"}.get(kind, expr) + f" as {name}")
    return ", ".join(out)


def add(name: str, ctes: str, spec: str, source: str, digits: int = 4) -> None:
    ORACLES[name] = (f"with {ctes} " if ctes else "") + f"select {cols(spec, digits)} from {source}"


BARS = eq.bars()
TECH = BARS + "," + eq.TECH
OBS = eq.observations(MIN_HISTORY)
DEC = ",".join([BARS, eq.TECH, eq.decomposition(MIN_HISTORY)])

# --- sources ---
add("history_bars", BARS, "ticker, d, o:r, c:r, v:r", "bars")
ORACLES["bar_quarantine"] = """with b as (select 'ORDER_'||cast(o_orderkey as varchar) as t, case when o_orderkey%11=0 then 'no_date' when o_orderkey%13=0 then 'close_not_positive'
  when o_orderkey%7=0 then 'no_close' when o_totalprice<=0 then 'close_not_positive' end as reason from orders)
 select reason, count(*) as bars, min(t) as first_ticker, max(t) as last_ticker from b where reason is not null group by reason"""
add("company_profiles", f"p as ({fx.PROFILE})", "ticker, company_name, quote_price:r, market_cap:r=market_cap/1e9, beta:r, volume:r, average_volume:r, change_pct:r, profile_sector, profile_industry", "p")
add("ttm_ratios", f"p as ({fx.RATIOS})", "ticker, gross_margin:r, operating_margin:r, pe_ttm:r", "p")
add("ttm_key_metrics", f"p as ({fx.METRICS})", "ticker, ev_to_ebitda:r, net_debt_ebitda:r, roic:r, fcf_yield:r", "p")
add("sector_pe_lookup", f"p as ({fx.SECTOR_PE}), o as (select o_orderkey, r_name as sector, cast(o_orderdate as date) as d from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey)",
    "o_orderkey, sector, d, pe:r, snapshot", "(select o.*, x.pe, x.date as snapshot from o left join lateral (select pe, date from p where p.sector=o.sector and pe is not null and p.date<=o.d order by date desc limit 1) x on true)")
add("index_strip", "", "symbol, label, value:r, change_pct:r", """(select s.symbol, s.label, o_totalprice as value, o_custkey%21/10.0e0-1 as change_pct,
  row_number() over (partition by s.symbol order by o_orderdate desc, o_orderkey desc) as rk from orders
  join (values (0,'SPY','S&P 500'),(1,'QQQ','Nasdaq 100'),(2,'DIA','Dow Jones'),(3,'IWM','Russell 2000')) s(m,symbol,label) on o_orderkey%5=s.m
  where o_orderkey%7<>0) where rk=1""")
ORACLES["payload_quarantine"] = """with j as (select doc_id, case when doc_id%5 in (0,3) then null when doc_id%5=4 and (text is null or trim(text)='') then 'empty'
  when doc_id%5=1 and not regexp_matches(text,'(?i)legacy|subscription|restricted|upgrade|special endpoint|limit reach') then 'provider_error'
  when regexp_matches(text,'(?i)legacy|subscription|restricted|upgrade|special endpoint|limit reach') then 'plan_limit' else 'not_json' end as reason from documents)
 select reason, count(*) as bodies, min(doc_id) as first_id, max(doc_id) as last_id from j group by reason"""
add("overlay_peers", f"{BARS}, ov as ({fx.OVERLAY})", "ticker, pos:i, peer, moat:r, catalyst_type, pe_5y_avg:r", "edges join ov using (ticker)")
add("history_cache", BARS, "ticker, sessions, first_d, last_d",
    "(select ticker, count(*) as sessions, min(d) as first_d, max(d) as last_d from bars group by ticker having count(*)>=356)")

FEED = f"""fl as ({fx.FILINGS}),
ent as (select *, regexp_matches(title,'^\\s*([A-Z0-9/-]+)\\s+-\\s+(.+?)\\s*\\((\\d{{7,10}})\\)') as hit from fl where k%23<>0 and (k//20)%10<>9),
li as (select *, case when hit then regexp_extract(title,'^\\s*([A-Z0-9/-]+)\\s+-\\s+(.+?)\\s*\\((\\d{{7,10}})\\)',1) else 'C' end as form_type,
  case when hit then regexp_extract(title,'^\\s*([A-Z0-9/-]+)\\s+-\\s+(.+?)\\s*\\((\\d{{7,10}})\\)',2) else title end as company_name,
  case when hit then regexp_extract(title,'^\\s*([A-Z0-9/-]+)\\s+-\\s+(.+?)\\s*\\((\\d{{7,10}})\\)',3) else '' end as cik,
  case when regexp_matches(href,'\\d{{10}}-\\d{{2}}-\\d{{6}}') then regexp_extract(href,'(\\d{{10}}-\\d{{2}}-\\d{{6}})',1)
       when regexp_matches(href,'\\d{{18}}') then regexp_replace(regexp_extract(href,'(\\d{{18}})',1),'^(\\d{{10}})(\\d{{2}})(\\d{{6}})$','\\1-\\2-\\3') else '' end as accession_number,
  case when contains(href,'/Archives/') then split_part(href,'/Archives/',2) else '' end as filing_path, updated as filed_at, href as edgar_url from ent),
lk as (select *, case when upper(form_type)='C' then 'offering' when upper(form_type)='C/A' then 'amendment' when form_type like 'C-U%' then 'update'
  when form_type like 'C-AR%' then 'annual_report' when form_type like 'C-W%' then 'withdrawal' else 'other' end as kind,
  concat_ws(',', case when not hit then 'title' end, case when accession_number='' then 'accession' end) as unparsed from li)"""
add("filing_listings", FEED, "company_name, cik, accession_number, filed_at, form_type, kind, filing_path, edgar_url, unparsed", "lk")
ORACLES["feed_report"] = f"""with fl as ({fx.FILINGS}),
en as (select *, k//20 as g, regexp_matches(title,'^\\s*([A-Z0-9/-]+)\\s+-\\s+(.+?)\\s*\\((\\d{{7,10}})\\)') as hit, regexp_matches(href,'\\d{{10}}-\\d{{2}}-\\d{{6}}|\\d{{18}}') as numbered,
  '<entry><title>'||replace(title,'&','&amp;')||'</title>'||case when k%23<>0 then '<link rel="alternate" href="'||href||'"/>' else '' end||'<updated>'||updated||'</updated></entry>' as e from fl),
hd as (select length('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Latest</title>') as h),
po as (select en.*, h+sum(length(e)) over (partition by g order by e rows unbounded preceding) as pos, h+7+sum(length(e)) over (partition by g) as total from en, hd),
ea as (select 'feed-'||g as path, po.* from po union all select 'feed-'||g||'-cut', po.* from po where pos<=cast(floor(total*2/3) as bigint))
 select distinct path, field from (select path, 'entry' as field from ea where g%10<>9 and k%23=0 union all select path, 'title' from ea where g%10<>9 and k%23<>0 and not hit
 union all select path, 'accession' from ea where g%10<>9 and k%23<>0 and not numbered union all select 'feed-'||g||'-cut', 'feed' from en where g%10<>9
 union all select 'feed-'||g||x, 'endpoint' from en, (values (''),('-cut')) t(x) where g%10=9) z"""
add("live_raises", FEED, "company_name, cik, accession_number, filed_at, kind",
    "(select * from lk where kind in ('offering','amendment'))")
ORACLES["form_kinds"] = f"""with fl as ({fx.FILINGS}), f as (select regexp_extract(title,'^\\s*([A-Z0-9/-]+)\\s+-\\s+(.+?)\\s*\\((\\d{{7,10}})\\)',1) as form_type from fl)
 select form_type, case when form_type='C' then 'offering' when form_type='C/A' then 'amendment' when form_type like 'C-U%' then 'update'
  when form_type like 'C-AR%' then 'annual_report' when form_type like 'C-W%' then 'withdrawal' else 'other' end as kind, count(*) as filings from f group by 1,2"""
OFFER = """sp as (select *, s_suppkey as k, abs(s_acctbal) as bal from supplier),
off as (select lpad(cast(k as varchar),10,'0')||'-26-000001' as accession_number,
  case when k%2=0 then s_name||' & Co' when k%4=1 then s_name end as issuer_name,
  case when k%5<2 then null when k%5=2 then floor(bal*10) else floor(bal*10)+0.5 end as offering_amount,
  case when k%4<>0 then floor(bal*100) end as maximum_offering_amount, case when k%2=0 then 'Common Stock' else 'SAFE' end as security_type,
  case when k%6<>0 then k%50+0.25 end as price, case when k%7<>0 then '12-31-2026' end as deadline, case when k%3=0 then 'DE' end as jurisdiction,
  concat_ws(',', case when k%5<2 then 'offeringAmount' end, case when k%4=0 then 'maximumOfferingAmount' end) as unparsed from sp)"""
add("offering_terms", OFFER, "accession_number, issuer_name, offering_amount:r, maximum_offering_amount:r, security_type, price:r, deadline, jurisdiction, unparsed", "off")
add("deal_skeletons", FEED + "," + OFFER,
    "deal_id, company_name, country, target_raise:r, tax_wrapper, pre_money:r, founders:i, company_number, unparsed",
    """(select 'edgar:'||coalesce(nullif(l.accession_number,''),nullif(l.cik,''),'link-'||md5(l.edgar_url)) as deal_id, coalesce(o.issuer_name,l.company_name) as company_name, 'US' as country,
  o.offering_amount as target_raise, 'NONE' as tax_wrapper, cast(null as double) as pre_money, 0 as founders, l.cik as company_number,
  case when o.accession_number is null then 'primary_doc' else o.unparsed end as unparsed
  from lk l left join off o on o.accession_number=l.accession_number)""")
add("deal_listings", FEED + "," + OFFER,
    "deal_id, unparsed, form_type, filed_at, filing_path",
    """(select 'edgar:'||coalesce(nullif(l.accession_number,''),nullif(l.cik,''),'link-'||md5(l.edgar_url)) as deal_id, case when o.accession_number is null then 'primary_doc' else o.unparsed end as unparsed,
  form_type, filed_at, filing_path from lk l left join off o on o.accession_number=l.accession_number)""")
POS = f"""pe as ({fx.POSITION_EVENTS}),
tg as (select ticker, count(*) as n, max(row(ts, seq)) as added, max(ts) as added_at from pe where action='toggle' group by ticker having count(*)%2=1),
en as (select pe.*, row_number() over (partition by pe.ticker order by pe.ts desc, pe.seq desc) as rk from pe join tg on tg.ticker=pe.ticker
       where action in ('enter','clear') and row(pe.ts, pe.seq)>tg.added),
pos as (select tg.ticker, tg.added_at, case when action='enter' then entry_price end as entry_price, case when action='enter' then size_pct end as size_pct
        from tg left join en on en.ticker=tg.ticker and rk=1)"""
add("filing_assessments", FEED, "deal_id, verdict, evidence_score:r, opacity_index:r, network_band",
    """(select 'edgar:'||coalesce(nullif(accession_number,''),nullif(cik,''),'link-'||md5(edgar_url)) as deal_id, 'INSUFFICIENT_DATA' as verdict, 'NONE' as network_band, 0.74 as opacity_index,
  floor((22.5e0*74+((0.9e0*3+0.6e0*2.5e0-1)/6.5e0+1)*50*16+50*10)/100*10+0.5e0)/10 as evidence_score from lk)""")
add("positions_current", POS, "ticker, added_at, entry_price:r, size_pct:r", "pos")

add("supplier_walk_forward", ",".join([eq.SUPPLIER_BARS, eq.TECH, eq.decomposition(40)]) + """, obs as (select dec.*, case when price>0 and a.c<>0 then (a.c/price-1)*100 end as fwd_1,
  case when price>0 and b.c<>0 then (b.c/price-1)*100 end as fwd_3 from dec left join bx a on a.ticker=dec.ticker and a.di=dec.t+1 left join bx b on b.ticker=dec.ticker and b.di=dec.t+3)""",
    "ticker, as_of, cause, confidence, total_pct:r, market_pct:r, beta_market:r, fwd_1:r, fwd_3:r", "(select * from obs where fwd_1 is not null or fwd_3 is not null)")

# --- technicals ---
for name, spec in {
    "returns": "ret:r, log_ret:r=lr, dip_pct_day:r, dip_pct_week:r",
    "moving_averages": "sma50:r, sma200:r",
    "rsi": "rsi14:r",
    "trailing_range": "high_52w:r, low_52w:r, drawdown_pct:r, range_position:r",
    "volatility": "realized_vol_pct:r, atr_pct:r, dip_z:r",
    "price_levels": "support_defined, support_level:r, resistance_level:r",
    "overnight_share": "gap_share:r",
    "volume_ratios": "avg_volume:r, volume_ratio:r",
}.items():
    add(name, TECH, "ticker, d, " + spec, "tech")
add("sparkline", BARS, "ticker, age:i, c:r, y:r=(c-lo)/case when hi=lo then 1 else hi-lo end, rising",
    """(select *, min(c) over (partition by ticker) as lo, max(c) over (partition by ticker) as hi,
  max(case when age=0 then c end) over (partition by ticker)>=max(case when age=oldest then c end) over (partition by ticker) as rising
  from (select *, max(age) over (partition by ticker) as oldest from (select *, row_number() over (partition by ticker order by d desc)-1 as age from bars) where age<40))""")

# --- factors and decomposition ---
add("session_axis", BARS, "d, di:i", "(select d, row_number() over (order by d)-1 as di from (select distinct d from bars))")


def factor(weight: str, by: str = "") -> str:
    p = f"partition by {by}" if by else ""
    g = f"{by}, " if by else ""
    u = f"using ({by}, d)" if by else "using (d)"
    size = f"(select {g} count(distinct ticker) as m from bars group by {by})" if by else "(select count(distinct ticker) as m from bars)"
    on = f"using ({by})" if by else "on true"
    return f"""fw as (select bars.*, {weight} as w from bars join caps using (ticker)),
fd as (select {g} d from (select {g} d, count(*) as n from bars group by {g} d) join {size} {on} where n=m),
fm as (select fw.*, lag(c) over (partition by ticker order by d) as p from fw join fd {u}),
ff as (select {g} d, sum(w*ln(c/p))/sum(case when p is not null then w end) as ret from fm group by {g} d),
factor as (select {g} d, ret, 100*exp(sum(coalesce(ret,0)) over ({p} order by d)) as level from ff)"""


CAPW = "case when market_cap_b>0 then market_cap_b else 1 end"
add("market_factor", BARS + "," + factor(CAPW), "d, ret:r, level:r", "factor")
add("sector_factors", BARS + "," + factor("1.0", "sector"), "sector, d, ret:r, level:r", "factor")
add("aligned_factor", BARS + "," + factor("1.0"), "ticker, d, aligned:r",
    """(select ticker, d, coalesce(last_value(level ignore nulls) over (partition by ticker order by d),
  first_value(level ignore nulls) over (partition by ticker order by d rows between unbounded preceding and unbounded following), 1) as aligned
  from bars left join factor using (d))""")
add("shared_sessions", BARS, "d, names:i",
    "(select d, count(*) as names from bars group by d having count(*)=(select count(distinct ticker) from bars))")
add("ols_betas", TECH + "," + factor("1.0"), "ticker, n:i, beta:r, pearson:r, variance_bp:r",
    """(select ticker, count(*) as n, coalesce(covar_pop(lr,f.ret)/nullif(var_pop(f.ret),0),0) as beta, coalesce(corr(lr,f.ret),0) as pearson,
  var_pop(lr)*10000 as variance_bp from tech join factor f using (d) where lr is not null and f.ret is not null group by ticker)""")
DECS = "cause, total_pct:r, market_pct:r, sector_pct:r, idio_pct:r, systematic_share:r, beta_market:r, beta_sector:r, residual_z:r, gap_share:r, confidence"
add("decompositions", DEC, "ticker, as_of, " + DECS, "dec")


def share(part: str) -> str:
    return f"{part}_share:r=case when total_pct=0 then 0 else least(100, abs({part}_pct/total_pct)*100) end"


add("decomposition_shares", DEC, "ticker, as_of, label, " + ", ".join(share(p) for p in ("market", "sector", "idio")),
    "(select *, array_to_string(list_transform(string_split(lower(cause),'_'), lambda x: upper(x[1])||x[2:]),' ') as label from dec)")


def signed(x: str, digits: int = 1, unit: str = "%%") -> str:
    return f"(case when {x}>=0 then '+' else '' end||printf('%.{digits}f{unit}', cast({x} as double)))"


GAP = "case when gap_share is null then '' when gap_share>=0.6 then ' Most of it came between sessions, as news does.' else ' Most of it came during sessions, as order flow does.' end"
ORACLES["cause_notes"] = f"""with {DEC} select ticker, as_of, cause, case cause
  when 'MARKET_BETA' then {signed('market_pct')}||' of '||{signed('total_pct')}||' follows from market exposure; '||{signed('idio_pct')}||' is specific to the name.'
  when 'SECTOR_ROTATION' then {signed('sector_pct')}||' of '||{signed('total_pct')}||' is the peer group moving beyond what the market explains.'
  when 'IDIOSYNCRATIC_SHOCK' then {signed('idio_pct')}||' of '||{signed('total_pct')}||' is specific to the name, a residual of '||printf('%.1f', residual_z)||' sigma.'||({GAP})||' The pattern points to new information.'
  when 'IDIOSYNCRATIC_NO_NEWS' then {signed('idio_pct')}||' of '||{signed('total_pct')}||' is specific to the name but ordinary at '||printf('%.1f', residual_z)||' sigma.'||({GAP})
  else 'History is too short to separate market, sector and name-specific parts.' end as note from dec"""
add("point_in_time_snapshots", DEC, "ticker, as_of, price:r, dip_pct_day:r, dip_pct_week:r, volume_ratio:r, rsi14:r, sma50:r, sma200:r, support_level:r, dip_z:r", "dec")

# --- live screen ---
LIVE_BARS = BARS.replace("bars as materialized (select", "raw as materialized (select", 1) + """,
newest as (select *, (c/lag(c) over (partition by ticker order by d)-1)*100 as ed, (c/lag(c,5) over (partition by ticker order by d)-1)*100 as ew from
  (select *, row_number() over (partition by ticker order by d desc) as age, count(*) over (partition by ticker) as nb from raw) where age<=300 and nb>=60),
bars as materialized (select ticker, sector, d, round(o,2) as o, round(c,2) as c, v, c as exact_close, coalesce(ed,0) as ed, coalesce(ew,0) as ew from newest)"""
# live: weights and snapshot come from the merged profile; moves from exact closes
SNAP = f"""ov as ({fx.OVERLAY}), pf as ({fx.PROFILE}), rt as ({fx.RATIOS}), mt as ({fx.METRICS}), spes as ({fx.SECTOR_PE}),
lastb as (select * from bars qualify row_number() over (partition by ticker order by d desc)=1),
sn0 as (select ov.*, pf.*exclude(ticker), rt.*exclude(ticker), mt.*exclude(ticker), lastb.d as last_d, lastb.exact_close, lastb.ed, lastb.ew, lastb.v,
   coalesce(nullif(profile_sector,''),overlay_sector) as sector from ov join lastb using (ticker) left join pf using (ticker) left join rt using (ticker) left join mt using (ticker)),
spe as (select ticker, arg_max(pe, date) as pe from sn0 join spes on spes.sector=sn0.sector and date<=last_d where pe is not null group by ticker),
snap as materialized (select sn0.ticker, sn0.sector, coalesce(nullif(company_name,''),name) as name, coalesce(nullif(profile_industry,''),overlay_industry) as industry,
   coalesce(market_cap,0)/1e9 as market_cap_b, coalesce(quote_price,exact_close) as price, coalesce(change_pct,ed) as dip_pct_day, ew as dip_pct_week,
   coalesce(beta,1) as beta, coalesce(average_volume,0)/1e6 as avg_volume_m,
   case when coalesce(average_volume,0)>0 then coalesce(volume,v)/average_volume else 1 end as volume_ratio,
   short_interest_pct, catalyst_type, catalyst_severity, coalesce(pe_ttm,pe_5y_avg) as pe_forward, pe_5y_avg, coalesce(spe.pe,pe_5y_avg*0.9e0) as sector_pe,
   coalesce(ev_to_ebitda,12) as ev_to_ebitda, coalesce(fcf_yield,0)*100 as fcf_yield_pct, coalesce(gross_margin,0)*100 as gross_margin_pct,
   coalesce(operating_margin,0)*100 as op_margin_pct, rev_growth_pct, eps_growth_pct, coalesce(roic,0)*100 as roic_pct,
   coalesce(net_debt_ebitda,0) as net_debt_to_ebitda, moat, balance_sheet from sn0 left join spe on spe.ticker=sn0.ticker)"""
LIVE_TECH = eq.TECH.replace("coalesce((c/pc-1)*100,0) as dip_pct_day, coalesce((c/c5-1)*100,0) as dip_pct_week", "ed as dip_pct_day, ew as dip_pct_week", 1)
LIVE_DEC = (
    eq.decomposition(60, last_only=True)
    .replace("join caps using (ticker)", "join (select ticker, market_cap_b from snap) using (ticker)", 1)
    .replace("qualify count(*) over (partition by t)>=3", "qualify count(*) over (partition by t)>=1", 1)
)
sc = eq.sc


def half(x: str) -> str:
    return f"cast(floor({x}+0.5e0) as int)"


CHAIN = f"""an1 as (select *, {half(f"({sc('roic_pct',4,30)}*0.22e0+{sc('moat',1,5)}*0.22e0+{sc('gross_margin_pct',20,70)}*0.12e0+{sc('op_margin_pct',5,35)}*0.12e0+{sc('rev_growth_pct',-5,25)}*0.12e0+{sc('-net_debt_to_ebitda',-4,1)}*0.1e0+{sc('balance_sheet',1,5)}*0.1e0)")} as quality_score,
   {half(f"({sc('(pe_5y_avg-pe_forward)/pe_5y_avg*100',-25,40)}*0.35e0+{sc('(sector_pe-pe_forward)/sector_pe*100',-60,40)}*0.2e0+{sc('fcf_yield_pct',0,7)}*0.25e0+(case when eps_growth_pct>0 then {sc('-(pe_forward/nullif(eps_growth_pct,0))',-4,-0.8)} else 15e0 end)*0.2e0)")} as valuation_score,
   {half(f"({sc('dip_z',0.8,3.5)}*0.45e0+{sc('volume_ratio',1,3.5)}*0.35e0+{sc('abs(dip_pct_day)/greatest(abs(dip_pct_week),0.1)',0.25,1)}*0.2e0)")} as dip_character_score,
   {half("greatest(0,least(100, case cause when 'MARKET_BETA' then 82e0 when 'SECTOR_ROTATION' then 66e0 when 'IDIOSYNCRATIC_NO_NEWS' then 60+greatest(-10,least(12,(1.5-abs(residual_z))*8)) when 'IDIOSYNCRATIC_SHOCK' then 22-greatest(0,least(15,(abs(residual_z)-2.5)*6)) else 50e0 end))")} as catalyst_score,
   {half(f"({sc('-rsi14',-55,-22)}*0.65e0+(case when support_defined then {sc('-(price-support_level)/price*100',-12,-0.5)} else 0 end)*0.35e0)")} as technical_score from an0),
an2 as (select *, {half(f"({sc('volume_ratio',0.9,3.2)}*0.55e0+(case when quality_score>=55 then {sc('short_interest_pct',1,12)} else {sc('-short_interest_pct',-15,-1)} end)*0.45e0)")} as flow_score from an1),
an3 as (select *, {half('(catalyst_score*0.22e0+dip_character_score*0.18e0+technical_score*0.12e0)/(0.22e0+0.18e0+0.12e0)')} as signal_score,
   {half('(quality_score*0.22e0+valuation_score*0.18e0+flow_score*0.08e0)/(0.22e0+0.18e0+0.08e0)')} as overlay_score,
   {half('(quality_score*0.22e0+catalyst_score*0.22e0+valuation_score*0.18e0+dip_character_score*0.18e0+technical_score*0.12e0+flow_score*0.08e0)')} as dip_score,
   greatest(quality_score,catalyst_score,valuation_score,dip_character_score,technical_score,flow_score)-least(quality_score,catalyst_score,valuation_score,dip_character_score,technical_score,flow_score) as spread from an2),
an4 as (select *, case when catalyst_score<30 then (case when signal_score>=40 then 'FALLING_KNIFE' else 'AVOID' end)
   when signal_score>=62 and catalyst_score>=60 and overlay_score>=45 then 'BUY_THE_DIP' when signal_score>=50 and catalyst_score>=55 and overlay_score>=45 then 'ACCUMULATE'
   when signal_score>=38 then 'WATCHLIST' when signal_score>=25 then 'FALLING_KNIFE' else 'AVOID' end as verdict,
   case when spread<35 and (signal_score>=62 or signal_score<38) then 'HIGH' when spread<55 then 'MODERATE' else 'LOW' end as conviction,
   dip_pct_week<0 as is_dip, price*(1-2.2e0*atr_pct/100) as atr_stop, price/(1+dip_pct_week/100) as pre from an3),
an5 as (select *, case when support_defined then least(price*0.985e0,support_level*1.01e0) else price*0.985e0 end as entry_low, price*1.008e0 as entry_high,
   case when support_defined then least(support_level*0.97e0,atr_stop) else atr_stop end as stop, price+(pre-price)*0.5e0 as target1,
   greatest(15e0,least(82e0,28+signal_score*0.55e0)) as win from an4),
an as materialized (select *, greatest(pre*0.99e0,target1) as target2, floor((case when price-stop>0 then (target1-price)/(price-stop) else 0 end)*100+0.5e0)/100 as risk_reward,
   {half('win')} as win_probability_pct, floor((win/100*((target1/price-1)*100)+(1-win/100)*((stop/price-1)*100))*10+0.5e0)/10 as expected_value_pct,
   floor((case verdict when 'BUY_THE_DIP' then 5e0 when 'ACCUMULATE' then 3e0 when 'WATCHLIST' then 1e0 else 0e0 end)*greatest(0.5e0,least(1.2e0,30/greatest(realized_vol_pct,15e0)))*10+0.5e0)/10 as suggested_size_pct,
   1e0 as max_risk_pct, case when catalyst_type in ('earnings_miss','guidance_cut') then '4–8 weeks' when catalyst_type in ('sector_sympathy','macro','no_news') then '2–5 weeks' else '6–12 weeks' end as horizon,
   dip_pct_week<0 and verdict not in ('FALLING_KNIFE','AVOID') as pub from an5)"""
LIVE = ",".join([LIVE_BARS, SNAP, LIVE_TECH, LIVE_DEC]) + f""",
an0 as (select snap.*, dec.*exclude(ticker, sector, price, dip_pct_day, dip_pct_week, volume_ratio, avg_volume, d, t) from snap join dec using (ticker)),
""" + CHAIN
add("live_snapshot", LIVE, "ticker, sector, name, industry, market_cap_b:r, price:r, dip_pct_day:r, dip_pct_week:r, beta:r, avg_volume_m:r, volume_ratio:r, pe_forward:r, sector_pe:r, ev_to_ebitda:r, fcf_yield_pct:r, gross_margin_pct:r, op_margin_pct:r, roic_pct:r, net_debt_to_ebitda:r", "snap")
add("live_admission", BARS, "ticker, sessions:i", "(select ticker, least(count(*),300) as sessions from bars group by ticker having count(*)>=60)")
add("live_decomposition", LIVE, "ticker, as_of, " + DECS, "an")
SCORES = "quality_score:i, catalyst_score:i, valuation_score:i, dip_character_score:i, technical_score:i, flow_score:i"
add("pillar_scores", LIVE, f"ticker, {SCORES}, signal_score:i, overlay_score:i, dip_score:i", "an")
add("pillar_scores_long", LIVE, "ticker, pillar, score:i, weight:r, provenance",
    "(" + " union all ".join(
        f"select ticker, '{p}' as pillar, {p}_score as score, {w} as weight, '{s}' as provenance from an"
        for p, w, s in (("quality", 0.22, "mixed"), ("catalyst", 0.22, "signal"), ("valuation", 0.18, "mixed"), ("dip_character", 0.18, "signal"), ("technical", 0.12, "signal"), ("flow", 0.08, "mixed"))
    ) + ")")
PIT = DEC + f""", ov as ({fx.OVERLAY}), an0 as (select dec.*, coalesce(name, ticker) as name, coalesce(catalyst_type,'no_news') as catalyst_type, coalesce(catalyst_severity,5) as catalyst_severity,
  coalesce(short_interest_pct,0) as short_interest_pct, coalesce(pe_5y_avg,20) as pe_5y_avg, coalesce(pe_5y_avg,20) as pe_forward, coalesce(pe_5y_avg,20)*0.9e0 as sector_pe,
  coalesce(rev_growth_pct,0) as rev_growth_pct, coalesce(eps_growth_pct,0) as eps_growth_pct, coalesce(moat,3) as moat, coalesce(balance_sheet,3) as balance_sheet,
  12e0 as ev_to_ebitda, 0e0 as fcf_yield_pct, 0e0 as gross_margin_pct, 0e0 as op_margin_pct, 0e0 as roic_pct, 0e0 as net_debt_to_ebitda
  from dec left join (select * from ov) using (ticker)), """ + CHAIN
add("point_in_time_analyses", PIT, f"ticker, as_of, name, {SCORES}, signal_score:i, overlay_score:i, dip_score:i, verdict, conviction, stop:r, target1:r, suggested_size_pct:r", "an")
add("verdicts", LIVE, "ticker, verdict, conviction, is_dip", "an")
add("trade_plans", LIVE, "ticker, entry_low:r, entry_high:r, stop:r, target1:r, target2:r, risk_reward:r, win_probability_pct:i, expected_value_pct:r, suggested_size_pct:r, max_risk_pct:r, horizon", "an")
add("published_plans", LIVE, "ticker, " + ", ".join(f"{x}:r=case when pub then {x} end" for x in ("entry_low", "entry_high", "stop", "target1", "target2")), "an")
FLAGS = (("leverage", "net_debt_to_ebitda>2.5"), ("earnings_impairment", "catalyst_severity>=6"), ("below_200_session_mean", "price<sma200"), ("no_support", "not support_defined"),
         ("high_volatility", "realized_vol_pct>45"), ("shorts_on_weak_business", "short_interest_pct>10 and quality_score<50"), ("sector_premium", "pe_forward>sector_pe*1.4"), ("deep_drawdown", "abs(drawdown_pct)>40"))
ORACLES["risk_flags"] = f"with {LIVE}, hits as (" + " union all ".join(f"select ticker, {n} as rule, '{f}' as flag from an where {cond}" for n, (f, cond) in enumerate(FLAGS)) + """)
 select ticker, row_number() over (partition by ticker order by rule)-1 as pos, flag from hits union all select ticker, 0, 'none' from an where ticker not in (select ticker from hits)"""
add("highlights", LIVE, "ticker, oversold=rsi14<30, volume_climax=volume_ratio>=2.5, large_dip=dip_z>=2, cash_generative=fcf_yield_pct>=4, high_return=roic_pct>=15, levered=net_debt_to_ebitda>2.5, moat=moat>=4, below_own_pe=pe_forward<pe_5y_avg, good_risk_reward=risk_reward>=1.5, residual_extreme=residual_z<=-2, vs_sma50_pct:r=(price/sma50-1)*100, vs_sma200_pct:r=(price/sma200-1)*100, stop_from_last_pct:r=(stop-price)/price*100, target1_from_last_pct:r=(target1-price)/price*100, band=case when signal_score>=72 then 'strong' when signal_score>=60 then 'good' when signal_score>=46 then 'neutral' when signal_score>=32 then 'weak' else 'poor' end", "an")
ORACLES["display_formats"] = f"""with {LIVE} select ticker, case when price>=1000 then format('{{:,.2f}}', price) else printf('%.2f', price) end as price,
  case when dip_pct_week>0 then '+' else '' end||printf('%.2f%%', dip_pct_week) as week,
  case when market_cap_b>=1000 then printf('$%.2fT', market_cap_b/1000) when market_cap_b>=1 then printf('$%.0fB', market_cap_b) else printf('$%.0fM', market_cap_b*1000) end as cap,
  printf('%.1fx', sector_pe) as sector_pe, lower(replace(verdict,'_',' ')) as verdict from an"""
SCREEN = "ticker, sector, verdict, signal_score:i, dip_pct_day:r, dip_pct_week:r, market_cap_b:r"
add("screen_by_score", LIVE, SCREEN, "an where is_dip order by signal_score desc, ticker")
add("screen_by_day", LIVE, SCREEN, "an where is_dip order by dip_pct_day, ticker")
add("screen_by_cap_in_sector", LIVE, SCREEN, "an where is_dip and sector='ASIA' order by market_cap_b desc, ticker")
add("screen_watchlist_by_week", LIVE, SCREEN, "an where is_dip and verdict='WATCHLIST' order by dip_pct_week, ticker")
add("ranked_analyses", LIVE, SCREEN, "an order by signal_score desc, ticker")
add("ticker_lookup", LIVE, SCREEN, "an where upper(ticker)='NATION_7'")
add("top_buys", LIVE, "ticker, signal_score:i", "(select * from an where is_dip and verdict='BUY_THE_DIP' order by signal_score desc, ticker limit 3)")
add("top_knives", LIVE, "ticker, signal_score:i", "(select * from an where is_dip and verdict in ('FALLING_KNIFE','AVOID') order by signal_score desc, ticker limit 4)")
add("breadth", LIVE, "covered:i=count(*), buyable:i=count(*) filter (where verdict in ('BUY_THE_DIP','ACCUMULATE')), avg_score:i=coalesce(floor(avg(dip_score)+0.5),0), avg_dip:r=coalesce(avg(dip_pct_week),0)", "an")
add("verdict_facets", LIVE, "pos:i, verdict, names:i",
    "(select pos, l.verdict, count(an.ticker) as names from (values (0,'BUY_THE_DIP'),(1,'ACCUMULATE'),(2,'WATCHLIST'),(3,'FALLING_KNIFE'),(4,'AVOID')) l(pos,verdict) left join an on an.verdict=l.verdict and an.is_dip group by all)")
add("sector_facets", LIVE, "sector", "(select distinct sector from an where is_dip)")
add("covered_peers", LIVE, "ticker, pos:i, peer, verdict, dip_pct_week:r, signal_score:i", "(select e.ticker, e.pos, e.peer, verdict, dip_pct_week, signal_score from edges e join an on an.ticker=e.peer)")
OPEN = LIVE + "," + POS + ", po as (select pos.*exclude(added_at), price, case when entry_price is not null then (price/entry_price-1)*100 end as pnl_pct, case when pub then stop end as published_stop, case when pub then target1 end as published_target1 from pos join an using (ticker))"
add("positions_open", OPEN, "ticker, entry_price:r, size_pct:r, price:r, pnl_pct:r, published_stop:r, published_target1:r", "po")
add("positions_uncovered", OPEN + f", ov2 as ({fx.OVERLAY})", "ticker, name", "(select pos.ticker, coalesce(ov2.name,'Not in coverage') as name from pos left join ov2 using (ticker) where pos.ticker not in (select ticker from an))")
add("positions_pnl", OPEN, "entered:i=count(pnl_pct), open_pnl_pct:r=coalesce(sum(pnl_pct*coalesce(size_pct,0))/greatest(sum(case when pnl_pct is not null then coalesce(size_pct,0) end),1),0)", "po")
add("chart_domains", LIVE + ", pts as (select * from (select *, row_number() over (partition by ticker order by d desc) as age2 from raw) where age2<=252)",
    "ticker, points:i, y_min:r, y_max:r",
    "(select ticker, count(*) as points, least(min(p.c), min(case when pub then stop end))*0.97e0 as y_min, greatest(max(p.c), max(case when pub then target2 end))*1.03e0 as y_max from pts p join an using (ticker) group by ticker)")

# --- walk-forward ---
add("walk_forward_observations", OBS, "ticker, as_of, signal_score:i, catalyst_score:i, dip_character_score:i, technical_score:i, cause, dip_pct_week:r, fwd_5:r, fwd_20:r, fwd_60:r", "obs")
add("forward_returns", OBS, "ticker, as_of, horizon:i, fwd_ret:r", "long")


def metrics(by: str, source: str = "long") -> str:
    return f"""mr as (select *, rank() over (partition by {by} order by signal_score)+(count(*) over (partition by {by}, signal_score)-1)/2.0e0 as rx,
  rank() over (partition by {by} order by fwd_ret)+(count(*) over (partition by {by}, fwd_ret)-1)/2.0e0 as ry,
  row_number() over (partition by {by} order by signal_score, as_of, ticker) as pos, count(*) over (partition by {by}) as tot from {source}),
met as (select {by}, count(*) as n, coalesce(corr(rx,ry),0) as ic, coalesce(avg(fwd_ret) filter (where pos>tot-greatest(1,floor(tot/5))),0) as top_mean,
  coalesce(avg(fwd_ret) filter (where pos<=greatest(1,floor(tot/5))),0) as bottom_mean,
  coalesce(avg(case when fwd_ret>0 then 1.0e0 else 0 end) filter (where signal_score>=50),0) as hit from mr group by {by}),
metrics as (select {by}, n, case when n<5 then 0 else ic end as ic, case when n<5 then 0 else top_mean end as top_mean, case when n<5 then 0 else bottom_mean end as bottom_mean,
  case when n<5 then 0 else top_mean-bottom_mean end as spread, case when n<5 then 0 else hit end as hit_rate_high from met)"""


METRICS = "n:i, ic:r, top_mean:r, bottom_mean:r, spread:r, hit_rate_high:r"
add("horizon_metrics", OBS + "," + metrics("horizon"), "horizon:i, " + METRICS, "metrics")
add("ic_by_year", OBS + ", ly as (select *, year(as_of) as year from long)," + metrics("year, horizon", "ly"), "year:i, horizon:i, " + METRICS, "metrics")
add("ic_by_half", OBS + ", hd as (select as_of, ntile(2) over (order by as_of) as half from (select distinct as_of from long)), lh as (select * from long join hd using (as_of))," + metrics("half, horizon", "lh"), "half:i, horizon:i, " + METRICS, "metrics")
HEADS = ", ".join(f"lpad({signed(f'coalesce(avg(fwd_{h}),0)', 2, '')}, 9, ' ')" for h in (5, 20, 60))
ORACLES["report_lines"] = "with " + OBS + "," + metrics("horizon") + f""", cz as (select cause, count(*) as n, rpad(cause,24,' ')||lpad(cast(count(*) as varchar),8,' ')||concat({HEADS}) as line from obs group by cause)
 select 0::bigint as section, 0::bigint as pos, 'Observations: '||count(*)||'  (falls only: true)' as line from obs
 union all select 1, horizon, concat_ws('  ', rpad(horizon||'d',6,' '), lpad(cast(n as varchar),8,' '), lpad(printf('%.3f',cast(ic as double)),6,' '), lpad({signed('top_mean', 2, '')},8,' '),
   lpad({signed('bottom_mean', 2, '')},8,' '), lpad({signed('spread', 2, '')},8,' '), printf('%3.0f%%',cast(hit_rate_high*100 as double))) from metrics
 union all select 2, row_number() over (order by n desc, cause), line from cz
 union all select 3, p, t from (values (0,'Survivors only; observations overlap and are correlated.'),(1,'No costs or slippage.'),(2,'A measured rank correlation can expose a broken score; it cannot prove an edge.')) c(p,t)"""
MEANS = "n:i=count(*), " + ", ".join(f"mean_{h}:r=coalesce(avg(fwd_{h}),0)" for h in (5, 20, 60))
add("cause_metrics", OBS, "cause, " + MEANS, "obs group by cause")
CHAIN_INDEX = """ci as (select d, count(lr) as names, sum(w*lr)/sum(case when lr is not null then w end) as r from (select ticker, d, case when market_cap_b>0 then market_cap_b else 1 end as w, ln(c/lag(c) over (partition by ticker order by d)) as lr
  from bars join caps using (ticker)) group by d),
factor as (select d, names, 100*exp(coalesce(sum(r) over (order by d),0)) as level from ci)"""
add("market_index", eq.SUPPLIER_BARS + "," + CHAIN_INDEX, "d, names:i, level:r, regime", "(select *, case when level>avg(level) over (order by d rows between 23 preceding and current row) then 'ABOVE' else 'BELOW' end as regime from factor)")
REG = OBS + "," + CHAIN_INDEX + """, rg as (select d, case when level>avg(level) over (order by d rows between 199 preceding and current row) then 'ABOVE' else 'BELOW' end as regime from factor),
known as (select a.d as as_of, last_value(regime ignore nulls) over (order by a.d) as regime from axis a left join rg on rg.d=a.d), obr as (select * from obs join known using (as_of))"""
add("regime_split", REG, "regime, " + MEANS, "obr group by regime")
add("regime_by_cause", REG, "regime, cause, " + MEANS, "obr group by regime, cause")
FEATURES = ("catalyst_score", "dip_character_score", "technical_score", "dip_z", "volume_ratio", "rsi14", "dip_pct_week", "drawdown_pct")
add("feature_ic", OBS + ", st as (" + " union all ".join(f"select '{f}' as feature, horizon, cast({f} as double) as x, fwd_ret from long" for f in FEATURES) + """),
 rk as (select *, rank() over (partition by feature, horizon order by x)+(count(*) over (partition by feature, horizon, x)-1)/2.0e0 as rx, rank() over (partition by feature, horizon order by fwd_ret)+(count(*) over (partition by feature, horizon, fwd_ret)-1)/2.0e0 as ry from st)""",
    "feature, horizon:i, n:i=count(*), ic:r=coalesce(corr(rx,ry),0)", "rk group by feature, horizon")
add("score_buckets", OBS, "bucket:i=floor(signal_score/10)*10, " + MEANS, "obs group by floor(signal_score/10)*10")
add("score_distribution", OBS, "n:i=count(*), mean:r=avg(signal_score), sd:r=stddev_pop(signal_score), lowest:i=min(signal_score), highest:i=max(signal_score)", "obs")
add("buy_grade_by_cause", OBS, "cause, n:i, buys:i, share_of_buys:r=coalesce(buys/nullif(sum(buys) over (),0),0)", "(select cause, count(*) as n, count(*) filter (where signal_score>=62) as buys from obs group by cause)")
add("buy_clustering", OBS, "buys:i=coalesce(sum(k),0), days:i=count(*), most_in_a_day:i=coalesce(max(k),0), crowded_share:r=coalesce(sum(case when k>=5 then k else 0 end)/nullif(sum(k),0),0)", "(select as_of, count(*) as k from obs where signal_score>=62 group by as_of)")
add("buy_grade_vs_rest", OBS, "buy_grade=signal_score>=62, " + MEANS, "obs group by signal_score>=62")


def floor_q(q: float, x: str, by: str, source: str) -> str:
    return f"(select {by}, list_sort(list({x}))[cast(floor({q}*(count(*)-1)) as bigint)+1] as v from {source} group by {by})"


add("return_quantiles", OBS, "horizon:i, p10:r, p50:r, p90:r", "(select horizon, a.v as p10, b.v as p50, c.v as p90 from " + f"{floor_q(0.1, 'fwd_ret', 'horizon', 'long')} a join {floor_q(0.5, 'fwd_ret', 'horizon', 'long')} b using (horizon) join {floor_q(0.9, 'fwd_ret', 'horizon', 'long')} c using (horizon))")
add("order_value_quantiles", "o as (select o_orderpriority, o_totalprice, cast(o_orderdate as date)-date '1990-01-01' as dn from orders), rk as (select *, rank() over (partition by o_orderpriority order by dn)+(count(*) over (partition by o_orderpriority, dn)-1)/2.0e0 as rx, rank() over (partition by o_orderpriority order by o_totalprice)+(count(*) over (partition by o_orderpriority, o_totalprice)-1)/2.0e0 as ry from o), ic as (select o_orderpriority, count(*) as n, corr(rx,ry) as ic from rk group by 1)",
    "o_orderpriority, p10:r, p50:r, p90:r, n:i, ic:r",
    "(select o_orderpriority, a.v as p10, b.v as p50, c.v as p90, n, ic from " + f"{floor_q(0.1, 'o_totalprice', 'o_orderpriority', 'o')} a join {floor_q(0.5, 'o_totalprice', 'o_orderpriority', 'o')} b using (o_orderpriority) join {floor_q(0.9, 'o_totalprice', 'o_orderpriority', 'o')} c using (o_orderpriority) join ic using (o_orderpriority))")

# --- private raises and streaming ---
for _name, (_ctes, _spec, _source, _digits) in RAISES.items():
    add(_name, _ctes, _spec, _source, _digits)
add("stream_session_bars", "", "ticker, d, o:r, h:r, l:r, c:r, v:i", """(select event_type as ticker, cast(date_trunc('day', ts) as date) as d, first(value order by ts, event_id) as o, max(value) as h, min(value) as l,
  last(value order by ts, event_id) as c, count(*) as v from events where value>0 group by 1,2)""")
ORACLES["stream_distinct_filings"] = """select lpad(cast(o_custkey as varchar),18,'0') as accession_number, case o_custkey%6 when 0 then 'offering' else 'amendment' end as kind,
 cast(min(o_orderdate) as date) as filed_on from orders where o_custkey%6 in (0,1) group by 1, 2"""
add("stream_positions", POS, "ticker, added_at, entry_price:r, size_pct:r", "pos")
add("stream_rescored", LIVE, "ticker, verdict, signal_score:i, dip_pct_week:r, market_pct:r", "an")
