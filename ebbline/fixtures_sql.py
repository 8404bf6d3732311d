"""Domain tables over the driver tables, in SQL that Spark and DuckDB both run unchanged.

Values follow from keys and measures of the rows; moduli inject the NULLs the disclosure rules need.
"""

OVERLAY = """
select n_name as ticker, concat(n_name, ' Holdings') as name, r_name as overlay_sector, concat(r_name, ' Goods') as overlay_industry,
 case n_nationkey % 10 when 0 then 'earnings_miss' when 1 then 'guidance_cut' when 2 then 'macro' when 3 then 'sector_sympathy'
   when 4 then 'analyst_downgrade' when 5 then 'regulatory' when 6 then 'competitive_threat' when 7 then 'structural_decline'
   when 8 then 'cost_shock' else 'no_news' end as catalyst_type,
 cast(n_nationkey % 11 as double) as catalyst_severity, cast((n_nationkey * 3) % 11 as double) as catalyst_transience,
 cast(1 + n_nationkey % 5 as double) as moat, cast(1 + (n_nationkey * 3) % 5 as double) as balance_sheet,
 cast(12 + n_nationkey % 20 as double) as pe_5y_avg, cast((n_nationkey * 7) % 30 - 5 as double) as rev_growth_pct,
 cast((n_nationkey * 5) % 40 - 10 as double) as eps_growth_pct, cast((n_nationkey * 13) % 20 as double) * 0.8e0 as short_interest_pct,
 n_nationkey as k
from nation join region on n_regionkey = r_regionkey"""

PROFILE = """
select n_name as ticker, case when n_nationkey % 5 = 0 then '' else concat(n_name, ' Plc') end as company_name,
 case when n_nationkey % 3 = 0 then null else 80e0 + avg(c_acctbal) / 200e0 end as quote_price,
 sum(greatest(c_acctbal, 0)) * 1e6 as market_cap, case when n_nationkey % 5 = 0 then null else 0.5e0 + count(*) / 100e0 end as beta,
 case when n_nationkey % 2 = 0 then null else cast(count(*) as double) * 30e0 end as volume,
 case when n_nationkey % 6 = 0 then null else cast(count(*) as double) * (10e0 + n_nationkey) end as average_volume,
 case when n_nationkey % 4 = 0 then null else (n_nationkey % 7 - 3) * 0.7e0 end as change_pct,
 case when n_nationkey % 4 = 1 then '' else r_name end as profile_sector,
 case when n_nationkey % 4 = 2 then null else concat(r_name, ' Trade') end as profile_industry
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by n_name, n_nationkey, r_name"""

RATIOS = """
select n_name as ticker, 0.25e0 + avg(c_acctbal) / 20000e0 as gross_margin, 0.02e0 + (n_nationkey % 9) * 0.04e0 as operating_margin,
 case when n_nationkey % 5 = 2 or n_nationkey % 8 = 7 then null else 8e0 + count(*) % 25 end as pe_ttm
from customer join nation on c_nationkey = n_nationkey group by n_name, n_nationkey"""

METRICS = """
select n_name as ticker, case when n_nationkey % 4 = 2 or n_nationkey % 9 = 8 then null else 6e0 + count(*) % 13 end as ev_to_ebitda,
 (n_nationkey % 7) - 2e0 as net_debt_ebitda, 0.03e0 + (n_nationkey % 6) * 0.05e0 as roic, (n_nationkey % 8) * 0.01e0 as fcf_yield
from customer join nation on c_nationkey = n_nationkey group by n_name, n_nationkey"""

SECTOR_PE = """
select r_name as sector, cast(date_trunc('month', o_orderdate) as date) + 14 as date,
 case when r_regionkey = 3 then null else 15e0 + cast(count(*) % 11 as double) end as pe
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by r_name, r_regionkey, cast(date_trunc('month', o_orderdate) as date) + 14"""

POSITION_EVENTS = """
select concat('NATION_', cast((o_custkey * 7 + o_orderkey) % 29 as varchar(4))) as ticker, o_orderdate as ts, o_orderkey as seq,
 case when o_orderkey % 5 < 2 then 'toggle' when o_orderkey % 5 < 4 then 'enter' else 'clear' end as action,
 case when o_orderkey % 5 in (2, 3) then 60e0 + o_totalprice / 4000e0 end as entry_price,
 case when o_orderkey % 5 in (2, 3) then cast(1 + o_orderkey % 6 as double) end as size_pct
from orders"""

DEALS = """
select concat('deal:', cast(c_custkey as varchar(20))) as deal_id, c_custkey as k, c_name as company_name,
 case when c_custkey % 3 = 0 then 'US' else 'UK' end as country,
 case when c_custkey % 3 = 0 or c_custkey % 11 = 0 then 'NONE' when c_custkey % 2 = 0 then 'SEIS' else 'EIS' end as tax_wrapper,
 case c_custkey % 6 when 0 then 'crowdcube' when 1 then 'seedrs' when 2 then 'republic' when 3 then 'WeFunder' when 4 then 'startengine' else 'other' end as platform,
 case c_custkey % 13 when 0 then 'b2b_saas' when 1 then 'fintech' when 2 then 'deeptech' when 3 then 'marketplace' when 4 then 'healthtech'
   when 5 then 'energy_climate' when 6 then 'gaming_media' when 7 then 'biotech' when 8 then 'proptech' when 9 then 'hardware'
   when 10 then 'consumer_d2c' when 11 then 'food_beverage' else 'other' end as sector,
 case c_custkey % 5 when 0 then 'pre_seed' when 1 then 'seed' when 2 then 'series_a' when 3 then 'growth' else 'unknown' end as stage,
 case when c_custkey % 5 = 0 then null else 1000000e0 + abs(c_acctbal) * 1000e0 end as pre_money,
 case when c_custkey % 4 = 0 then null when c_custkey % 97 = 1 then 0e0 else 50000e0 + abs(c_acctbal) * 40e0 end as revenue_ltm,
 case when c_custkey % 7 = 0 then null else cast((c_custkey * 37) % 160 - 10 as double) end as revenue_growth_pct,
 case when c_custkey % 6 = 5 then null else cast((c_custkey * 29) % 80 as double) end as gross_margin_pct,
 case when c_custkey % 8 = 3 then null else cast((c_custkey * 11) % 24 as double) end as runway_months,
 case when c_custkey % 9 = 2 then null else (c_custkey * 17) % 50 / 10e0 end as ltv_cac,
 case when c_custkey % 10 = 4 then null else (c_custkey * 19) % 100 / 10e0 end as churn_pct_monthly,
 case c_custkey % 7 when 0 then 'ordinary' when 1 then 'ordinary_non_voting' when 2 then 'a_shares' when 3 then 'b_shares' when 4 then 'preferred' when 5 then 'unknown' else 'ordinary' end as share_class,
 case when c_custkey % 8 = 0 then null when c_custkey % 8 < 5 then false else true end as has_preemption_rights,
 case when c_custkey % 8 = 0 then null when c_custkey % 16 = 2 then null when c_custkey % 8 < 4 then false else true end as has_information_rights,
 case when c_custkey % 8 = 0 then null when c_custkey % 2 = 0 then false else true end as has_voting_rights,
 case when c_custkey % 9 = 5 then null when c_custkey % 2 = 0 then true else false end as nominee_structure,
 case when c_custkey % 10 = 7 then null else cast(30 + (c_custkey * 23) % 60 as double) end as founder_retained_pct,
 case when c_custkey % 12 = 0 then false else true end as has_registry,
 case when c_custkey % 15 = 1 then null else date '2012-01-01' + cast((c_custkey * 31) % 4000 as integer) end as incorporated_on,
 case when c_custkey % 29 = 0 then 'overdue' when c_custkey % 31 = 0 then 'strike_off_proposed' when c_custkey % 10 = 1 then 'unknown' else 'current' end as filing_health,
 case when c_custkey % 37 = 0 then true else false end as accounts_overdue,
 case when c_custkey % 41 = 0 then true else false end as confirmation_overdue,
 cast(case when c_custkey % 4 = 1 then c_custkey % 3 else 0 end as integer) as outstanding_charges,
 cast(c_custkey % 6 as integer) as active_directors,
 cast(case when c_custkey % 5 = 2 then null else c_custkey % 6 end as integer) as n_co_investors,
 case when c_custkey % 9 = 0 then null when c_custkey % 9 = 1 then false else true end as has_professional_lead,
 cast(case when c_custkey % 4 = 3 then null else (c_custkey * 53) % 3000 end as integer) as investor_count,
 case when c_custkey % 3 = 1 then null when c_custkey % 2 = 0 then true else false end as founder_accessible,
 case when c_custkey % 5 = 4 then null else ((c_custkey * 7) % 15 - 2) / 10e0 end as sector_adjacency,
 case when c_custkey % 7 = 6 then null when c_custkey % 7 < 2 then true else false end as syndicate_access
from customer"""

FOUNDERS = """
select concat('deal:', cast(c_custkey as varchar(20))) as deal_id, j as pos, concat('Founder ', cast(c_custkey as varchar(20)), '-', cast(j as varchar(2))) as name,
 case when (c_custkey + j) % 4 = 0 then null else cast((c_custkey * 3 + j * 5) % 25 as double) end as domain_years,
 case when (c_custkey + j) % 3 = 0 then null when (c_custkey + j) % 5 < 2 then true else false end as prior_founder,
 case when (c_custkey * 2 + j) % 11 = 0 then true when (c_custkey + j) % 2 = 0 then false else null end as prior_exit,
 case when (c_custkey + 2 * j) % 5 = 0 then null when (c_custkey + j) % 3 < 2 then true else false end as full_time,
 cast(case when (c_custkey + j) % 23 = 0 then 2 + j when (c_custkey + j) % 17 = 0 then 1 else 0 end as integer) as insolvency_count
from customer join (values (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2), (4, 3)) as f(m, j) on m = c_custkey % 5"""

POSITIONS = """
select c_mktsegment as dist_id, o_custkey as investor, o_orderdate as taken, o_orderkey as seq,
  case when q < 50 then 0e0 when q < 63 then 0.3e0 when q < 80 then 1e0 when q < 90 then 2e0 when q < 96 then 5e0 when q < 99 then 10e0 else 30e0 end as multiple
from (select c_mktsegment, o_custkey, o_orderdate, o_orderkey, (o_orderkey * 7919 + o_custkey * 104729) % 100 as q from orders join customer on o_custkey = c_custkey) x"""

OUTCOMES = f"""
select dist_id, multiple, cast(count(*) as double) / sum(count(*)) over (partition by dist_id) as p from ({POSITIONS}) y
group by dist_id, multiple"""

FILINGS = """
select concat(case s_suppkey % 6 when 0 then 'C' when 1 then 'C/A' when 2 then 'C-U' when 3 then 'C-AR' when 4 then 'C-W' else 'C-TR' end,
  case when s_suppkey % 17 = 0 then ': ' else ' - ' end, s_name, ' (', lpad(cast(s_suppkey as varchar(10)), 10, '0'), ') (Filer)') as title,
 case when s_suppkey % 13 = 0 then concat('https://www.sec.gov/Archives/edgar/data/', cast(s_suppkey as varchar(10)), '/', lpad(cast(s_suppkey as varchar(10)), 10, '0'), '26000001/')
  when s_suppkey % 19 = 0 then concat('https://www.sec.gov/cgi-bin/browse?cik=', cast(s_suppkey as varchar(10)))
  else concat('https://www.sec.gov/Archives/edgar/data/', cast(s_suppkey as varchar(10)), '/', lpad(cast(s_suppkey as varchar(10)), 10, '0'), '26000001/',
   lpad(cast(s_suppkey as varchar(10)), 10, '0'), '-26-000001-index.htm') end as href,
 concat('2026-0', cast(1 + s_suppkey % 9 as varchar(2)), '-', lpad(cast(1 + s_suppkey % 28 as varchar(2)), 2, '0'), 'T12:00:00Z') as updated,
 s_suppkey as k
from supplier"""
