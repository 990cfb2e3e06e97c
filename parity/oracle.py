"""Independent ANSI-SQL answers for the queries in __spark_entry__.py.

Each relation is one named SELECT; `sql_for` strings together the ones a query
needs. Money is carried as integer paise and every rounded ratio is integer
arithmetic, so nothing depends on the order rows are added up in.
"""

from __future__ import annotations

import re


def ratio(num: str, den: str, digits: int) -> str:
    """num / den rounded half away from zero; NULL for a zero denominator."""
    p = 10 ** digits
    n, d = f"CAST({num} AS HUGEINT)", f"CAST(NULLIF({den}, 0) AS HUGEINT)"
    return f"(CAST(sign({n}) * ((2 * abs({n}) * {p} + {d}) // (2 * {d})) AS DOUBLE) / {p})"


def rupees(paise: str) -> str:
    return f"(CAST({paise} AS DOUBLE) / 100)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def micro(x: str) -> str:
    """A value carried at six decimals, as an integer."""
    return f"CAST(round({x} * 1000000) AS BIGINT)"


AT_RISK, CONFIRMED, FLOOR, MULT, MIN_GAPS = 30, 65, 21, "2.0e0", 5
EARLY, LABEL, MIN_BASE = 6, 6, 5
TAKE = "0.0042e0"

R: dict[str, str] = {}

# ---------------------------------------------------------------- sources ---
R["tx"] = """
SELECT o.o_custkey AS merchant_id, l.l_shipdate AS txn_ts,
       CAST(l.l_shipdate AS DATE) AS txn_date,
       CAST(date_trunc('month', l.l_shipdate) AS DATE) AS txn_month,
       CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS paise,
       n.n_name AS issuer_bank,
       l.l_returnflag <> 'R' AS ok,
       CASE WHEN l.l_returnflag = 'R' THEN NULLIF(o.o_orderpriority, '') END AS reason
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey"""

R["mer"] = """
SELECT c.c_custkey AS merchant_id, c.c_mktsegment AS category,
       CASE c.c_nationkey % 3 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'tier_2' ELSE 'tier_3' END AS city_tier,
       CASE c.c_custkey % 4 WHEN 0 THEN 'field_sales' WHEN 1 THEN 'self_serve'
                            WHEN 2 THEN 'referral' ELSE 'partner_bank' END AS acquisition_channel,
       CASE c.c_custkey % 3 WHEN 0 THEN 'qr_static' WHEN 1 THEN 'soundbox' ELSE 'pos' END AS device_type,
       n.n_name AS state, c.c_acctbal > 0 AS gst_registered,
       CAST((c.c_custkey * 37) % 97 AS DOUBLE) / 97 AS competitor_density
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey"""

R["tk"] = """
SELECT o_custkey AS merchant_id, o_orderdate AS created_at,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS ticket_month,
       CASE WHEN o_orderstatus = 'F' THEN 'PAYMENT_FAILURE' ELSE 'OTHER' END AS ticket_category,
       o_orderstatus <> 'O' AS resolved
FROM orders WHERE o_orderpriority = '1-URGENT'"""

R["st"] = f"""
SELECT merchant_id, CAST(month || '-01' AS DATE) AS settle_month,
       {ratio('hundredths', '100 * n', 3)} AS avg_settlement_delay_days
FROM (SELECT o.o_custkey AS merchant_id, strftime(l.l_shipdate, '%Y-%m') AS month, count(*) AS n,
             sum(CAST(CAST(l.l_tax * 100 AS DECIMAL(18,2)) * 100 AS BIGINT)) AS hundredths
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2)"""

R["span"] = "SELECT min(txn_date) AS d0, max(txn_date) AS d1 FROM tx"

# ------------------------------------------------------------------ facts ---
R["mbm"] = """
SELECT merchant_id, txn_month AS month, issuer_bank, count(*) AS tried,
       CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS won,
       sum(CASE WHEN ok THEN paise END) AS tpv, sum(paise) AS asked
FROM tx GROUP BY ALL"""

R["mm"] = f"""
WITH a AS (
  SELECT merchant_id, txn_month AS month, count(*) AS tried,
         CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS won,
         sum(CASE WHEN ok THEN paise END) AS tpv, sum(paise) AS asked,
         count(DISTINCT txn_date) AS days, count(DISTINCT issuer_bank) AS issuers,
         floor(quantile_cont(CASE WHEN ok THEN CAST(paise AS DOUBLE) END, 0.5) + 0.5) AS mid,
         min(txn_date) AS d0, max(txn_date) AS d1
  FROM tx GROUP BY 1, 2),
t AS (
  SELECT merchant_id, ticket_month AS month, count(*) AS raised,
         CAST(sum(CASE WHEN resolved THEN 0 ELSE 1 END) AS BIGINT) AS unresolved,
         CAST(sum(CASE WHEN ticket_category = 'PAYMENT_FAILURE' THEN 1 ELSE 0 END) AS BIGINT) AS payfail
  FROM tk GROUP BY 1, 2)
SELECT a.*, {ratio('a.won', 'a.tried', 6)} AS sr, a.asked - coalesce(a.tpv, 0) AS lost,
       CAST((2 * a.tpv + a.won) // (2 * NULLIF(a.won, 0)) AS BIGINT) AS ticket,
       coalesce(t.raised, 0) AS raised, coalesce(t.unresolved, 0) AS unresolved,
       coalesce(t.payfail, 0) AS payfail, s.avg_settlement_delay_days AS delay
FROM a LEFT JOIN t USING (merchant_id, month)
LEFT JOIN st s ON s.merchant_id = a.merchant_id AND s.settle_month = a.month"""

R["dense"] = f"""
WITH own AS (SELECT merchant_id, min(month) AS m0 FROM mm GROUP BY 1),
cal AS (SELECT own.merchant_id, CAST(u.m AS DATE) AS month
        FROM own, (SELECT max(month) AS m1 FROM mm) e,
             unnest(generate_series(own.m0, e.m1, INTERVAL 1 MONTH)) AS u(m)),
j AS (SELECT cal.merchant_id, cal.month, coalesce(mm.tried, 0) AS tried, coalesce(mm.won, 0) AS won,
             coalesce(mm.tpv, 0) AS tpv, mm.sr, coalesce(mm.unresolved, 0) AS unresolved, mm.delay,
             CASE WHEN mm.tried IS NULL THEN 0 ELSE 1 END AS live
      FROM cal LEFT JOIN mm USING (merchant_id, month))
SELECT j.*, lag(tpv) OVER w AS prev_tpv,
       sum(won) OVER (w ROWS 2 PRECEDING) AS won3, sum(tried) OVER (w ROWS 2 PRECEDING) AS tried3,
       sum(tpv) OVER (w ROWS 2 PRECEDING) AS tpv3,
       row_number() OVER w AS tenure, sum(live) OVER w AS live_to_date,
       lag(live) OVER w AS was, lead(live) OVER w AS will
FROM j WINDOW w AS (PARTITION BY merchant_id ORDER BY month)"""

# ------------------------------------------------------------------ churn ---
R["gap"] = """
SELECT * FROM (
  SELECT merchant_id, txn_date,
         txn_date - lag(txn_date) OVER (PARTITION BY merchant_id ORDER BY txn_date) AS gap
  FROM (SELECT DISTINCT merchant_id, txn_date FROM tx WHERE ok))
WHERE gap IS NOT NULL"""


def rhythm(gaps: str, end: str) -> str:
    return f"""
SELECT merchant_id, count(*) AS n, {ratio('sum(gap)', 'count(*)', 3)} AS mean_gap,
       round(quantile_cont(CAST(gap AS DOUBLE), 0.9), 6) AS p90,
       round(quantile_cont(CAST(gap AS DOUBLE), 0.5), 6) AS p50
FROM {gaps}, {end} e WHERE txn_date < e.d1 - {AT_RISK} GROUP BY merchant_id"""


def churn_status(tx: str, end: str, base: str) -> str:
    return f"""
WITH v AS (
  SELECT merchant_id, max(CASE WHEN ok THEN txn_date END) AS last_ok, max(txn_date) AS last_any,
         min(txn_date) AS first_any, count(DISTINCT txn_month) AS months,
         sum(CASE WHEN ok AND txn_date > e.d1 - 30 THEN paise END) AS now30,
         sum(CASE WHEN ok AND txn_date > e.d1 - 120 AND txn_date <= e.d1 - 30 THEN paise END) AS prior90,
         CAST(sum(CASE WHEN txn_date > e.d1 - 30 THEN 1 ELSE 0 END) AS BIGINT) AS tried30,
         CAST(sum(CASE WHEN ok AND txn_date > e.d1 - 30 THEN 1 ELSE 0 END) AS BIGINT) AS won30
  FROM {tx} x, {end} e GROUP BY merchant_id),
s AS (
  SELECT mer.*, e.d1, v.* EXCLUDE (merchant_id), e.d1 - v.last_ok AS silent,
         b.n AS gaps, b.mean_gap, b.p50, b.p90,
         coalesce(v.now30, 0) AS n30, coalesce(v.prior90, 0) AS p_90
  FROM mer JOIN v USING (merchant_id) CROSS JOIN {end} e LEFT JOIN {base} b USING (merchant_id)),
f AS (
  SELECT s.*, CASE WHEN silent >= {AT_RISK} THEN 1 ELSE 0 END AS d1f,
         CASE WHEN coalesce(gaps, 0) < {MIN_GAPS} THEN CASE WHEN silent >= {AT_RISK} THEN 1 ELSE 0 END
              WHEN silent > greatest({FLOOR}, {MULT} * p90) THEN 1 ELSE 0 END AS d2f
  FROM s)
SELECT f.*, CASE WHEN d2f = 1 OR (p_90 > 0 AND n30 * 12 < p_90) THEN 1 ELSE 0 END AS d3f FROM f"""


R["base"] = rhythm("gap", "span")
R["cs"] = churn_status("tx", "span", "base")

# ---------------------------------------------------------------- cohorts ---
R["coh"] = f"""
WITH own AS (SELECT merchant_id, min(month) AS c FROM mm GROUP BY 1),
size AS (SELECT c, count(*) AS n FROM own GROUP BY 1),
cell AS (SELECT own.c, mm.month, count(DISTINCT mm.merchant_id) AS live, sum(mm.tpv) AS tpv
         FROM mm JOIN own USING (merchant_id) GROUP BY 1, 2)
SELECT cell.c AS cohort_month, cell.month AS activity_month,
       {big("datediff('month', cell.c, cell.month)")} AS month_index, size.n AS cohort_size,
       cell.live AS active_merchants, {ratio('cell.live', 'size.n', 4)} AS logo_retention,
       {rupees('cell.tpv')} AS tpv_inr, {ratio('cell.tpv', 'z.tpv', 4)} AS tpv_retention
FROM cell JOIN size ON size.c = cell.c LEFT JOIN cell z ON z.c = cell.c AND z.month = cell.c"""

R["nh"] = f"""
WITH t AS (SELECT month, count(DISTINCT merchant_id) AS live, sum(tpv) AS tpv, sum(won) AS won,
                  sum(tried) AS tried, sum(lost) AS lost, sum(raised) AS raised FROM mm GROUP BY 1),
f AS (SELECT month, count_if(tenure = 1) AS fresh, count_if(live = 1 AND was = 0) AS back,
             count_if(live = 0 AND was = 1) AS quiet, count_if(live = 0 AND was = 1 AND will = 0) AS gone
      FROM dense GROUP BY 1),
g AS (SELECT t.*, coalesce(f.fresh, 0) AS fresh, coalesce(f.back, 0) AS back, coalesce(f.quiet, 0) AS quiet,
             coalesce(f.gone, 0) AS gone, lag(live) OVER (ORDER BY t.month) AS live0,
             lag(tpv) OVER (ORDER BY t.month) AS tpv0
      FROM t LEFT JOIN f ON f.month = t.month)
SELECT g.*, {ratio('won', 'tried', 6)} AS sr,
       CASE WHEN month IN (SELECT max(month) FROM t UNION ALL SELECT min(month) FROM t) THEN 1 ELSE 0 END AS edge
FROM g"""

# --------------------------------------------------------------- incident ---
R["bm"] = f"""
SELECT month, issuer_bank, {big('sum(tried)')} AS tried, {big('sum(won)')} AS won,
       {ratio('sum(won)', 'sum(tried)', 6)} AS sr, sum(asked) AS asked, sum(asked) - sum(tpv) AS lost,
       {ratio('sum(tried)', 'sum(sum(tried)) OVER (PARTITION BY month)', 6)} AS share
FROM mbm GROUP BY month, issuer_bank"""

R["early"] = f"SELECT DISTINCT month FROM bm QUALIFY dense_rank() OVER (ORDER BY month) <= {EARLY}"

R["srb"] = """
SELECT issuer_bank, CAST(sum(won) AS DOUBLE) / sum(tried) AS sr0,
       CAST(sum(tried) AS DOUBLE) / (SELECT sum(tried) FROM bm SEMI JOIN early USING (month)) AS share0,
       (SELECT CAST(sum(won) AS DOUBLE) / sum(tried) FROM bm SEMI JOIN early USING (month)) AS net0
FROM bm SEMI JOIN early USING (month) GROUP BY issuer_bank"""

R["con"] = """
SELECT bm.month, bm.issuer_bank, bm.sr, bm.share, bm.lost, b.sr0, b.share0,
       round(bm.sr - b.sr0, 6) AS sr_delta, round(b.share0 * (bm.sr - b.sr0), 8) AS rate_effect,
       round((bm.share - b.share0) * (b.sr0 - b.net0), 8) AS mix_effect,
       round((bm.share - b.share0) * (bm.sr - b.sr0), 8) AS interaction_effect
FROM bm JOIN srb b USING (issuer_bank)"""

R["rank"] = f"""
WITH w AS (
  SELECT issuer_bank, {ratio(f"sum({micro('sr')})", '1000000 * count(*)', 6)} AS avg_success_rate,
         {ratio(f"sum({micro('share')})", '1000000 * count(*)', 6)} AS avg_volume_share,
         min(sr_delta) AS worst_sr_delta,
         {ratio('sum(CAST(round(rate_effect * 100000000) AS BIGINT))', '100000000', 6)} AS cumulative_rate_effect,
         {rupees('sum(lost)')} AS total_failed_value_inr
  FROM con GROUP BY 1)
SELECT w.*, 1 + (SELECT count(*) FROM w x WHERE x.avg_success_rate < w.avg_success_rate) AS rank_by_worst_sr,
       1 + (SELECT count(*) FROM w x WHERE x.cumulative_rate_effect < w.cumulative_rate_effect)
         AS rank_by_network_impact
FROM w"""

R["worst"] = "SELECT arg_min(issuer_bank, (cumulative_rate_effect, issuer_bank)) AS issuer_bank FROM rank"

R["expo"] = f"""
WITH p AS (SELECT merchant_id, issuer_bank, sum(tried) AS k FROM mbm SEMI JOIN early USING (month) GROUP BY 1, 2)
SELECT p.merchant_id, p.issuer_bank, {big('p.k')} AS attempts_pre, {ratio('p.k', 't.k', 6)} AS exposure_share
FROM p JOIN (SELECT merchant_id, sum(k) AS k FROM p GROUP BY 1) t USING (merchant_id)"""

# --------------------------------------------------------------- features ---
R["cut"] = f"""
SELECT min(month) AS m0, max(month) AS m1,
       (SELECT min(month) FROM (SELECT DISTINCT month FROM mm QUALIFY dense_rank() OVER (ORDER BY month DESC) <= {LABEL})) AS l0,
       (SELECT d1 FROM span) AS d1
FROM mm"""

R["feat0"] = f"""
WITH x AS (
  SELECT mm.*, row_number() OVER (PARTITION BY merchant_id ORDER BY month) AS up,
         row_number() OVER (PARTITION BY merchant_id ORDER BY month DESC) AS down
  FROM mm, cut WHERE mm.month < cut.l0)
SELECT merchant_id, count(*) AS active_months, {big('sum(tried)')} AS attempted_txns,
       {big('sum(won)')} AS successful_txns, sum(tpv) AS tpv,
       {ratio('sum(tpv)', '100 * count(tpv)', 2)} AS avg_monthly_tpv,
       {ratio('sum(tried)', 'count(*)', 3)} AS avg_monthly_txns,
       round(stddev_samp(CAST(tpv AS DOUBLE) / 100) / NULLIF(CAST(sum(tpv) AS DOUBLE) / 100 / count(tpv), 0), 4) AS tpv_cv,
       {ratio('sum(won)', 'sum(tried)', 6)} AS success_rate,
       round(CAST(sum(CASE WHEN down <= 3 THEN won END) AS DOUBLE) / NULLIF(sum(CASE WHEN down <= 3 THEN tried END), 0)
           - CAST(sum(CASE WHEN up <= 3 THEN won END) AS DOUBLE) / NULLIF(sum(CASE WHEN up <= 3 THEN tried END), 0), 6) AS sr_trend,
       {ratio('sum(ticket)', '100 * count(ticket)', 2)} AS avg_ticket_inr,
       {ratio('sum(days)', 'count(*)', 2)} AS avg_active_days,
       {big('sum(raised)')} AS tickets_raised, {big('sum(unresolved)')} AS tickets_unresolved,
       {big('sum(payfail)')} AS tickets_payment_failure,
       {ratio(f"sum({micro('delay')})", '1000000 * count(delay)', 4)} AS avg_settlement_delay_days
FROM x GROUP BY merchant_id"""

R["feat"] = f"""
WITH seen AS (
  SELECT merchant_id, max(CASE WHEN txn_date < cut.l0 THEN txn_date END) AS before,
         max(txn_date) AS ever
  FROM tx, cut WHERE ok GROUP BY 1),
g AS (SELECT merchant_id, quantile_cont(CAST(gap AS DOUBLE), 0.9) AS p90, {ratio('sum(gap)', 'count(*)', 3)} AS mean_gap
      FROM gap, cut WHERE txn_date < cut.l0 GROUP BY 1),
e AS (SELECT merchant_id, round(coalesce(sum(CASE WHEN issuer_bank = (SELECT issuer_bank FROM worst)
                                                  THEN exposure_share END), 0), 6) AS x
      FROM expo GROUP BY 1),
j AS (
  SELECT f.*, mer.* EXCLUDE (merchant_id), CAST(d.won3 AS DOUBLE) AS won3, d.tried3, d.tenure, g.p90, g.mean_gap, e.x,
         seen.before, cut.l0 - seen.before AS recency,
         CASE WHEN coalesce(seen.ever, DATE '1900-01-01') < cut.d1 - {CONFIRMED} THEN 1 ELSE 0 END AS churned
  FROM feat0 f JOIN mer USING (merchant_id) CROSS JOIN cut
  LEFT JOIN seen USING (merchant_id)
  LEFT JOIN dense d ON d.merchant_id = f.merchant_id AND d.month = CAST(cut.l0 - INTERVAL 1 MONTH AS DATE)
  LEFT JOIN g ON g.merchant_id = f.merchant_id LEFT JOIN e ON e.merchant_id = f.merchant_id)
SELECT merchant_id, category, city_tier, acquisition_channel, device_type, state, gst_registered, competitor_density,
       active_months, attempted_txns, successful_txns, {rupees('tpv')} AS tpv_inr, avg_monthly_tpv, avg_monthly_txns,
       tpv_cv, success_rate, {ratio('won3', 'tried3', 6)} AS success_rate_3m_at_cutoff, sr_trend, avg_ticket_inr,
       avg_active_days, tickets_raised, tickets_unresolved, tickets_payment_failure, avg_settlement_delay_days,
       coalesce(tenure, active_months) AS tenure_months, round(coalesce(p90, 15), 2) AS p90_gap_days,
       coalesce(mean_gap, 5) AS mean_gap_days, x AS degraded_issuer_exposure, {big('recency')} AS recency_days,
       {big('ntile(5) OVER (ORDER BY before NULLS LAST, merchant_id)')} AS r_score,
       {big('ntile(5) OVER (ORDER BY attempted_txns NULLS LAST, merchant_id)')} AS f_score,
       {big('ntile(5) OVER (ORDER BY tpv NULLS LAST, merchant_id)')} AS m_score,
       {big('churned')} AS churned
FROM j"""

R["tiles"] = f"""
SELECT feat.*, ntile(10) OVER (ORDER BY degraded_issuer_exposure NULLS LAST, merchant_id) AS decile
FROM feat SEMI JOIN (SELECT merchant_id FROM expo GROUP BY 1 HAVING sum(attempts_pre) >= {MIN_BASE}) e USING (merchant_id)"""

# ---------------------------------------------------------------- revenue ---
R["rr"] = """
SELECT merchant_id, sum(tpv) AS total, count(tpv) AS n, CAST(sum(tpv) AS DOUBLE) / 100 / NULLIF(count(tpv), 0) AS rate,
       sum(tpv) * 6 // NULLIF(count(tpv), 0) AS sixths
FROM (SELECT merchant_id, tpv FROM mm QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY month DESC) <= 3)
GROUP BY 1"""

R["rar"] = f"""
WITH s AS (
  SELECT cs.merchant_id, CASE WHEN silent >= {CONFIRMED} THEN 'confirmed_churn' WHEN silent >= {AT_RISK} THEN 'at_risk'
                              ELSE 'active' END AS status, rr.sixths, feat.degraded_issuer_exposure AS x,
         feat.degraded_issuer_exposure > (SELECT quantile_cont(degraded_issuer_exposure, 0.5) FROM feat) AS above
  FROM cs JOIN rr USING (merchant_id) LEFT JOIN feat USING (merchant_id))
SELECT status, count(*) AS merchants, {ratio('sum(sixths)', '600', 2)} AS monthly_tpv_at_risk,
       {ratio('sum(sixths) * 12 * 42', '6000000', 2)} AS annualised_revenue_at_risk,
       {ratio(f"sum({micro('x')})", '1000000 * count(x)', 4)} AS avg_issuer_exposure,
       {ratio('sum(CASE WHEN above THEN sixths ELSE 0 END) * 12 * 42', '6000000', 2)} AS attributable_revenue_at_risk
FROM s GROUP BY status"""

# Final SELECT of each query, in terms of the relations above.
Q: dict[str, str] = {}

Q["transactions_typed"] = f"""
SELECT merchant_id, txn_ts, txn_date, txn_month, {rupees('paise')} AS amount_inr, issuer_bank,
       CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS status, reason AS failure_reason FROM tx"""
Q["merchants"] = "SELECT * FROM mer"
Q["tickets_typed"] = "SELECT * FROM tk"
Q["settlements_typed"] = "SELECT * FROM st"
Q["analysis_window"] = """
SELECT d0 AS first_date, d1 AS observation_date, CAST(date_trunc('month', d1) AS DATE) AS observation_month FROM span"""
Q["merchant_month"] = f"""
SELECT merchant_id, month, tried AS attempted_txns, won AS successful_txns, tried - won AS failed_txns,
       sr AS success_rate, {rupees('tpv')} AS tpv_inr, {rupees('asked')} AS attempted_value_inr,
       {rupees('lost')} AS failed_value_inr, days AS active_days, {rupees('ticket')} AS avg_ticket_inr,
       mid / 100 AS median_ticket_inr, issuers AS distinct_issuers, d0 AS first_txn_date, d1 AS last_txn_date,
       raised AS tickets_raised, unresolved AS tickets_unresolved, payfail AS tickets_payment_failure,
       delay AS avg_settlement_delay_days FROM mm"""
Q["merchant_bank_month"] = f"""
SELECT merchant_id, month, issuer_bank, tried AS attempted_txns, won AS successful_txns,
       {ratio('won', 'tried', 6)} AS success_rate, {rupees('tpv')} AS tpv_inr,
       {rupees('asked')} AS attempted_value_inr FROM mbm"""
Q["merchant_month_dense"] = f"""
SELECT merchant_id, month, tried AS attempted_txns, won AS successful_txns, {rupees('tpv')} AS tpv_inr,
       sr AS success_rate, unresolved AS tickets_unresolved, delay AS avg_settlement_delay_days,
       {big('live')} AS was_active, {rupees('prev_tpv')} AS prev_tpv_inr, {rupees('tpv - prev_tpv')} AS tpv_mom_delta,
       CASE WHEN prev_tpv > 0 THEN {ratio('tpv - prev_tpv', 'prev_tpv', 6)} END AS tpv_mom_pct,
       {ratio('won3', 'tried3', 6)} AS success_rate_3m, {rupees('tpv3')} AS tpv_3m, tenure AS tenure_months,
       {big('live_to_date')} AS active_months_to_date FROM dense"""
Q["merchant_activity_gaps"] = f"SELECT merchant_id, txn_date, {big('gap')} AS gap_days FROM gap"
Q["gap_baseline"] = """
SELECT merchant_id, n AS baseline_gap_count, mean_gap AS mean_gap_days, p90 AS p90_gap_days, p50 AS p50_gap_days
FROM base"""
Q["last_seen"] = """
SELECT merchant_id, last_ok AS last_success_date, last_any AS last_attempt_date, first_any AS first_txn_date,
       months AS months_with_activity FROM cs"""
Q["recent_value"] = f"""
SELECT merchant_id, {rupees('now30')} AS tpv_30d, {rupees('prior90')} AS tpv_prior_90d, tried30 AS attempts_30d,
       won30 AS successes_30d FROM cs"""
STATUS_COLUMNS = f"""
       merchant_id, category, city_tier, acquisition_channel, device_type, state, d1 AS observation_date,
       first_any AS first_txn_date, last_ok AS last_success_date, months AS months_with_activity,
       {big('silent')} AS days_since_last_success, gaps AS baseline_gap_count, p50 AS p50_gap_days,
       p90 AS p90_gap_days, CAST(greatest({FLOOR}, round({MULT} * coalesce(p90, 15), 1)) AS DOUBLE) AS adaptive_threshold_days,
       {rupees('n30')} AS tpv_30d, {rupees('p_90')} AS tpv_prior_90d,
       CASE WHEN p_90 > 0 THEN {ratio('n30 * 3', 'p_90', 4)} END AS tpv_run_rate_ratio,
       {big('d1f')} AS churn_d1_naive, {big('d2f')} AS churn_d2_adaptive, {big('d3f')} AS churn_d3_value_decay"""
Q["merchant_churn_status"] = f"SELECT {STATUS_COLUMNS} FROM cs"
Q["churn_definition_comparison"] = f"""
SELECT count(*) AS merchants_scored, {big('sum(d1f)')} AS d1_flagged, {big('sum(d2f)')} AS d2_flagged,
       {big('sum(d3f)')} AS d3_flagged, {ratio('sum(d1f)', 'count(*)', 4)} AS d1_rate,
       {ratio('sum(d2f)', 'count(*)', 4)} AS d2_rate, {ratio('sum(d3f)', 'count(*)', 4)} AS d3_rate,
       count_if(d1f > d2f) AS d1_only, count_if(d2f > d1f) AS d2_only, count_if(d3f > d2f) AS d3_incremental,
       count_if(last_ok IS NULL) AS never_succeeded FROM cs"""
Q["cohort_retention"] = "SELECT * FROM coh"
Q["cohort_m3_retention"] = """
SELECT cohort_month, cohort_size, logo_retention AS m3_logo_retention, tpv_retention AS m3_tpv_retention
FROM coh WHERE month_index = 3"""
Q["merchant_transitions"] = f"""
SELECT merchant_id, month, {big('live')} AS was_active, {big('was')} AS prev_active, {big('will')} AS next_active,
       tenure AS rn FROM dense"""
Q["network_health_monthly"] = f"""
SELECT month, live AS active_merchants, fresh AS new_merchants, back AS reactivated_merchants,
       quiet AS went_silent_merchants, gone AS churned_merchants, {rupees('tpv')} AS tpv_inr, sr AS success_rate,
       {rupees('lost')} AS failed_value_inr, {big('raised')} AS tickets_raised,
       {ratio('tpv', '100 * live', 2)} AS tpv_per_active_merchant,
       {ratio('live - live0', 'live0', 6)} AS merchant_mom_growth, {ratio('tpv - tpv0', 'tpv0', 6)} AS tpv_mom_growth,
       fresh + back - quiet AS net_merchant_adds, {big('edge')} AS is_censored_boundary FROM nh"""
Q["bank_month_sr"] = f"""
SELECT month, issuer_bank, tried AS attempted_txns, won AS successful_txns, sr AS success_rate,
       {rupees('asked')} AS attempted_value_inr, {rupees('lost')} AS failed_value_inr, share AS volume_share FROM bm"""
Q["sr_baseline"] = """
SELECT issuer_bank, sr0 AS sr_baseline, share0 AS share_baseline, net0 AS network_sr_baseline FROM srb"""
Q["sr_contribution"] = f"""
SELECT month, issuer_bank, sr AS success_rate, sr0 AS sr_baseline, share AS volume_share, share0 AS share_baseline,
       sr_delta, rate_effect, mix_effect, interaction_effect, {rupees('lost')} AS failed_value_inr FROM con"""
Q["incident_culprit_ranking"] = "SELECT * FROM rank"
Q["degraded_issuer"] = "SELECT issuer_bank FROM worst"
Q["failure_reason_mix"] = f"""
SELECT txn_month AS month, issuer_bank, reason AS failure_reason, count(*) AS failures,
       {ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY txn_month, issuer_bank)', 6)} AS reason_share
FROM tx WHERE NOT ok GROUP BY 1, 2, 3"""
Q["merchant_bank_exposure"] = "SELECT * FROM expo"
Q["feature_split"] = """
SELECT m0 AS window_start, l0 AS label_start, m1 AS window_end, d1 AS observation_date FROM cut"""
Q["merchant_features"] = "SELECT * FROM feat"
Q["sr_trend"] = "SELECT merchant_id, sr_trend FROM feat0"
Q["rfm_scores"] = "SELECT merchant_id, r_score, f_score, m_score FROM feat"
Q["exposure_vs_churn"] = f"""
SELECT {big('decile')} AS exposure_decile, round(min(degraded_issuer_exposure), 4) AS min_exposure,
       round(max(degraded_issuer_exposure), 4) AS max_exposure, count(*) AS merchants,
       {ratio('sum(churned)', 'count(*)', 4)} AS churn_rate,
       {ratio("count_if(city_tier = 'tier_3')", 'count(*)', 4)} AS tier3_share,
       {ratio(f"sum({micro('success_rate_3m_at_cutoff')})", '1000000 * count(success_rate_3m_at_cutoff)', 4)} AS avg_sr_at_cutoff
FROM tiles GROUP BY decile"""
Q["realised_failure_loss"] = f"""
SELECT month, {rupees('lost')} AS failed_value_inr, round({rupees('lost')} * {TAKE}, 2) AS revenue_lost_inr,
       sr AS success_rate,
       round(greatest(0.0, (SELECT CAST(sum({micro('sr')}) AS DOUBLE) / 1000000 / count(*) FROM nh SEMI JOIN early USING (month)) - sr)
             * {rupees('lost + tpv')} * {TAKE}, 2) AS excess_revenue_lost_inr FROM nh"""
Q["run_rate"] = "SELECT merchant_id, rate AS monthly_tpv_run_rate FROM rr"
Q["revenue_at_risk"] = "SELECT * FROM rar"


def needed(text: str) -> list[str]:
    """Relations a SELECT reads, dependencies first."""
    out: list[str] = []
    started: set[str] = set()

    def visit(body: str) -> None:
        for name in R:
            if name not in started and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", body):
                started.add(name)
                visit(R[name])
                out.append(name)
    visit(text)
    return out


def sql_for(query: str) -> str:
    return with_relations(Q[query])


def with_relations(body: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({R[n]}\n)" for n in needed(body)]
    if body.strip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def all_sql() -> dict[str, str]:
    return {name: sql_for(name) for name in Q}


# ------------------------------------------------------------- evaluation ---
OUTCOME = 90
R["span_t"] = f"SELECT d0, d1 - {OUTCOME} AS d1 FROM span"
R["tx_t"] = "SELECT tx.* FROM tx, span_t WHERE txn_date <= span_t.d1"
R["gap_t"] = "SELECT gap.* FROM gap, span_t WHERE txn_date <= span_t.d1"
R["base_t"] = rhythm("gap_t", "span_t")
R["cs_t"] = churn_status("tx_t", "span_t", "base_t")
R["past"] = f"""
SELECT cs_t.*, NOT coalesce(b.back, FALSE) AS actual, coalesce(silent >= {AT_RISK}, FALSE) AND coalesce(b.back, FALSE) AS dormant
FROM cs_t LEFT JOIN (SELECT DISTINCT merchant_id, TRUE AS back FROM tx, span_t WHERE ok AND txn_date > span_t.d1) b USING (merchant_id)"""


def confusion_sql(source: str, keys: str, hit: str, extra: str = "") -> str:
    return f"""
SELECT {keys}{extra}, tp, fp, fn, tn, tp + fp AS flagged, coalesce({ratio('tp', '(tp + fp)', 4)}, 0) AS precision,
       coalesce({ratio('tp', '(tp + fn)', 4)}, 0) AS recall, coalesce({ratio('2 * tp', '(2 * tp + fp + fn)', 4)}, 0) AS f1
FROM (SELECT {keys}{extra}, count_if(h AND actual) AS tp, count_if(h AND NOT actual) AS fp,
             count_if(NOT h AND actual) AS fn, count_if(NOT h AND NOT actual) AS tn
      FROM (SELECT *, coalesce({hit}, FALSE) AS h FROM {source}) GROUP BY ALL)"""


R["fx"] = confusion_sql("(SELECT silent, actual, CAST(u.w AS BIGINT) AS window_days FROM past, unnest(range(10, 121, 5)) AS u(w))",
                        "window_days", "silent >= window_days")
R["ad"] = (
    "WITH g AS (SELECT CAST(1 + 0.25 * i AS DOUBLE) AS multiplier FROM range(0, 21) AS r(i)),\n"
    f"z AS (SELECT silent, actual, coalesce(gaps, 0) AS k, multiplier, greatest({FLOOR}, multiplier * coalesce(p90, 15)) AS cut_at FROM past, g),\n"
    "m AS (SELECT multiplier, round(quantile_cont(CAST(cut_at AS DOUBLE), 0.5), 6) AS median_threshold_days FROM z GROUP BY 1)\n"
    "SELECT * FROM (" + confusion_sql("z", "multiplier",
        f"CASE WHEN k < {MIN_GAPS} THEN silent >= {AT_RISK} ELSE silent > cut_at END") + ") JOIN m USING (multiplier)")
MEAS = "tp, fp, fn, tn, flagged, precision, recall, f1"
R["rules"] = f"""
SELECT 'conventional' AS rule, CAST(window_days AS DOUBLE) AS setting, {MEAS} FROM fx WHERE window_days = {AT_RISK}
UNION ALL SELECT * FROM (SELECT 'best_fixed', CAST(window_days AS DOUBLE), {MEAS} FROM fx ORDER BY f1 DESC, window_days LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'best_adaptive', multiplier, {MEAS} FROM ad ORDER BY f1 DESC, multiplier LIMIT 1)"""
R["tiers"] = f"""
SELECT 'at_risk' AS tier, window_days, {MEAS} FROM fx WHERE window_days = {AT_RISK}
UNION ALL
SELECT 'confirmed', window_days, {MEAS} FROM fx WHERE window_days = coalesce(
  (SELECT min(window_days) FROM fx WHERE precision >= 0.95),
  (SELECT min(window_days) FROM fx WHERE precision = (SELECT max(precision) FROM fx)))"""

Q["asof_status"] = f"SELECT {STATUS_COLUMNS}, actual, dormant FROM past"
Q["rule_score"] = confusion_sql(
    "(SELECT u.rule, actual, CASE u.rule WHEN 'naive' THEN d1f WHEN 'adaptive' THEN d2f ELSE d3f END = 1 AS flagged_by "
    "FROM past, unnest(['naive', 'adaptive', 'value_decay']) AS u(rule))", "rule", "flagged_by")
Q["fixed_window_sweep"] = "SELECT * FROM fx"
Q["adaptive_sweep"] = "SELECT * FROM ad"
Q["best_rules"] = "SELECT * FROM rules"
Q["two_tier_point"] = "SELECT * FROM tiers"
FP = f"coalesce(silent >= {AT_RISK}, FALSE) AND NOT actual"
Q["false_positive_profile"] = f"""
SELECT count_if({FP}) AS false_positives, count_if({FP} AND dormant) AS of_which_dormant,
       coalesce({ratio(f'count_if({FP} AND dormant)', f'count_if({FP})', 4)}, 0) AS share_dormant,
       round(quantile_cont(CASE WHEN {FP} THEN p90 END, 0.5), 6) AS median_p90_gap_fp,
       round(quantile_cont(p90, 0.5), 6) AS median_p90_gap_population FROM past"""
Q["rate_by_category"] = f"""
SELECT category, count(*) AS merchants, {ratio(f'count_if({FP})', 'count(*)', 4)} AS fp_rate FROM past GROUP BY category"""
Q["evaluation_summary"] = f"""
SELECT count(*) AS merchants_scored, {ratio('count_if(actual)', 'count(*)', 4)} AS true_churn_rate,
       (SELECT max(precision) FROM fx) AS precision_ceiling FROM past"""
Q["rule_comparison"] = """
SELECT rule, precision, recall, f1 FROM rules UNION ALL SELECT tier, precision, recall, f1 FROM tiers WHERE tier = 'confirmed'"""

# ------------------------------------------------------------ forecasting ---
HOLD, AHEAD, SEASON, LOW = 5, 6, 12, "0.92e0"
R["ser"] = f"""
WITH e AS (SELECT CAST(CASE WHEN day(d1 + 1) = 1 THEN date_trunc('month', d1)
                            ELSE date_trunc('month', d1) - INTERVAL 1 MONTH END AS DATE) AS m1 FROM span),
c AS (SELECT issuer_bank AS series, month, sum(tpv) AS y, {ratio('sum(won)', 'sum(tried)', 6)} AS sr
      FROM mbm, e WHERE month <= e.m1 GROUP BY 1, 2),
k AS (SELECT series, CAST(u.m AS DATE) AS month
      FROM (SELECT series, min(month) AS m0 FROM c GROUP BY 1), e, unnest(generate_series(m0, e.m1, INTERVAL 1 MONTH)) AS u(m))
SELECT k.series, k.month, coalesce(c.y, 0) AS paise, CAST(coalesce(c.y, 0) AS DOUBLE) / 100 AS y, c.sr,
       CASE WHEN coalesce(c.sr, 1) < {LOW} THEN 1 ELSE 0 END AS x,
       row_number() OVER (PARTITION BY k.series ORDER BY k.month) AS i,
       count(*) OVER (PARTITION BY k.series) AS n
FROM k LEFT JOIN c USING (series, month)"""
R["trn"] = f"SELECT series, i, y, x, n - {HOLD} AS n FROM ser WHERE i <= n - {HOLD}"


def baseline_sql(train: str, h: int) -> str:
    return f"""
WITH s AS (SELECT u.step FROM unnest(range(1, {h} + 1)) AS u(step)),
a AS (SELECT series, any_value(n) AS n, arg_min(y, i) AS y0, arg_max(y, i) AS y1 FROM {train} GROUP BY 1)
SELECT series, 'naive_last_value' AS model, step, y1 AS p FROM a, s
UNION ALL SELECT series, 'drift', step, y1 + (y1 - y0) / (n - 1) * step FROM a, s
UNION ALL SELECT a.series, 'seasonal_naive', s.step, t.y FROM a, s, {train} t
          WHERE a.n > {SEASON} AND t.series = a.series AND t.i = a.n - {SEASON} + (s.step - 1) % {SEASON} + 1"""


def holt_sql(train: str) -> str:
    """Last state of every grid point; the fold is a recursive walk over the months."""
    ahead = "(h.level + h.p * h.trend)"
    return f"""
WITH RECURSIVE grid AS (SELECT a, b, p FROM unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) AS u(a),
    unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) AS v(b), unnest([0.8e0, 0.9e0, 0.98e0]) AS w(p)),
h AS (
  SELECT t1.series, a, b, p, t1.n, CAST(1 AS BIGINT) AS i, t1.y AS level, t2.y - t1.y AS trend, 0.0e0 AS sse
  FROM {train} t1 JOIN {train} t2 ON t2.series = t1.series AND t1.i = 1 AND t2.i = 2 CROSS JOIN grid
  UNION ALL
  SELECT h.series, h.a, h.b, h.p, h.n, h.i + 1, {ahead} + h.a * (t.y - {ahead}), h.p * h.trend + h.a * h.b * (t.y - {ahead}),
         h.sse + (t.y - {ahead}) * (t.y - {ahead})
  FROM h JOIN {train} t ON t.series = h.series AND t.i = h.i + 1)
SELECT series, any_value(n) AS n, arg_min(level, (sse, a, b, p)) AS level, arg_min(trend, (sse, a, b, p)) AS trend,
       arg_min(p, (sse, a, b, p)) AS p, arg_min(a, (sse, a, b, p)) AS a, arg_min(b, (sse, a, b, p)) AS b, min(sse) AS sse FROM h WHERE i = n GROUP BY series"""


def arima_sql(train: str, beta: bool) -> str:
    shift = "coalesce(CAST(sum(dx * dy) AS DOUBLE) / NULLIF(sum(dx * dx), 0), 0)" if beta else "0.0e0"
    vals = "unnest([-0.8e0, -0.6e0, -0.4e0, -0.2e0, 0.0e0, 0.2e0, 0.4e0, 0.6e0, 0.8e0])"
    return f"""
WITH RECURSIVE d AS (SELECT *, y - lag(y) OVER (PARTITION BY series ORDER BY i) AS dy,
                            x - lag(x) OVER (PARTITION BY series ORDER BY i) AS dx FROM {train}),
bb AS (SELECT series, {shift} AS beta FROM d GROUP BY series),
z AS (SELECT d.series, i, n, beta, y - beta * x AS z FROM d JOIN bb USING (series)),
ws AS (SELECT *, z - lag(z) OVER (PARTITION BY series ORDER BY i) AS w FROM z),
grid AS (SELECT f, t FROM {vals} AS u(f), {vals} AS v(t)),
r AS (
  SELECT series, f, t, n, beta, i, z, w, 0.0e0 AS e, 0.0e0 AS css FROM ws, grid WHERE i = 2
  UNION ALL
  SELECT r.series, r.f, r.t, r.n, r.beta, ws.i, ws.z, ws.w, ws.w - r.f * r.w - r.t * r.e,
         r.css + (ws.w - r.f * r.w - r.t * r.e) * (ws.w - r.f * r.w - r.t * r.e)
  FROM r JOIN ws ON ws.series = r.series AND ws.i = r.i + 1)
SELECT series, any_value(n) AS n, any_value(beta) AS beta, any_value(z) AS z, arg_min(f, (css, f, t)) AS f, arg_min(t, (css, f, t)) AS t,
       arg_min(f * w + t * e, (css, f, t)) AS w1, min(css) AS css FROM r WHERE i = n GROUP BY series"""


def fitted_sql(holt: str, arima: str, arimax: str, h: int, future: str) -> str:
    s = f"(SELECT u.step FROM unnest(range(1, {h} + 1)) AS u(step)) s"
    def reach(base: str, first: int) -> str:
        return f"list_reduce(list_transform(range({first}, s.step + {first}), lambda k: pow({base}, k)), lambda a, v: a + v)"
    return f"""
SELECT series, 'holt_damped' AS model, s.step, level + {reach('p', 1)} * trend AS p FROM {holt}, {s}
UNION ALL SELECT series, 'arima', s.step, z + w1 * {reach('f', 0)} FROM {arima}, {s}
UNION ALL SELECT a.series, 'arima_with_intervention', s.step, a.z + a.w1 * {reach('a.f', 0)} + a.beta * {future} FROM {arimax} a, {s}"""


R["hb"] = baseline_sql("trn", HOLD)
R["hh"] = holt_sql("trn")
R["ha"] = arima_sql("trn", False)
R["hx"] = arima_sql("trn", True)
R["hf"] = fitted_sql("hh", "ha", "hx", HOLD,
                     "(SELECT q.x FROM ser q WHERE q.series = a.series AND q.i = a.n + s.step)")
R["pred0"] = "SELECT * FROM hb UNION ALL SELECT * FROM hf"


def predictions_sql(source: str, ser: str = "ser") -> str:
    return f"""
SELECT h.series, h.model, CAST(h.step AS BIGINT) AS step, ser.month, ser.y, round(h.p, 2) AS predicted
FROM {source} h JOIN {ser} AS ser ON ser.series = h.series AND ser.i = ser.n - {HOLD} + h.step"""


R["pred"] = predictions_sql("pred0")
def errors_sql(source: str) -> str:
    return f"""
SELECT series, model,
       {ratio('sum(CAST(round(abs(y - predicted) / NULLIF(abs(y), 0) * 100000000) AS BIGINT)) * 100', '100000000 * count(NULLIF(y, 0))', 3)} AS mape_pct,
       {ratio('sum(CAST(round(abs(y - predicted) * 100) AS BIGINT))', '100 * count(*)', 0)} AS mae_inr
FROM {source} GROUP BY 1, 2"""


R["err"] = errors_sql("pred")
R["brd"] = """
SELECT series, arg_min(model, (mape_pct, model)) AS best_model, min(mape_pct) AS best_mape_pct,
       max(CASE WHEN model = 'naive_last_value' THEN mape_pct END) AS naive_mape_pct, count(*) AS models,
       min(mape_pct) < max(CASE WHEN model = 'naive_last_value' THEN mape_pct END) AS beats_naive
FROM err GROUP BY series"""
R["pb"] = baseline_sql("ser", AHEAD)
R["ph"] = holt_sql("ser")
R["pa"] = arima_sql("ser", False)
R["px"] = arima_sql("ser", True)
R["pf"] = fitted_sql("ph", "pa", "px", AHEAD, "0")


def sigma_sql(train: str, holt: str, arima: str, arimax: str) -> str:
    return f"""
WITH d AS (SELECT series, i, n, y - lag(y) OVER w AS d1, y - lag(y, {SEASON}) OVER w AS d12,
                  (last_value(y) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                   - first_value(y) OVER (PARTITION BY series ORDER BY i)) / (n - 1) AS slope
           FROM {train} WINDOW w AS (PARTITION BY series ORDER BY i))
SELECT series, 'naive_last_value' AS model, sqrt(sum(d1 * d1) / count(d1)) AS sigma FROM d GROUP BY 1
UNION ALL SELECT series, 'drift', sqrt(sum((d1 - slope) * (d1 - slope)) / count(d1)) FROM d GROUP BY 1
UNION ALL SELECT series, 'seasonal_naive', sqrt(sum(d12 * d12) / count(d12)) FROM d GROUP BY 1
UNION ALL SELECT series, 'holt_damped', sqrt(sse / (n - 1)) FROM {holt}
UNION ALL SELECT series, 'arima', sqrt(css / greatest(n - 2, 1)) FROM {arima}
UNION ALL SELECT series, 'arima_with_intervention', sqrt(css / greatest(n - 2, 1)) FROM {arimax}"""


def spread_sql(train: str, holt: str, arima: str, arimax: str, h: int) -> str:
    """Deviation of the error of a step: squared weights of the moving-average form, added up."""
    s = f"(SELECT u.step FROM unnest(range(1, {h} + 1)) AS u(step)) s"

    def summed(weight: str) -> str:
        return f"sqrt(1 + coalesce(list_sum(list_transform(range(1, s.step), lambda j: pow({weight}, 2))), 0))"
    holt_w = "a + a * b * list_sum(list_transform(range(1, j + 1), lambda k: pow(p, k)))"
    arima_w = "1 + (f + t) * list_sum(list_transform(range(0, j), lambda k: pow(f, k)))"
    return f"""
SELECT series, 'naive_last_value' AS model, s.step, sqrt(s.step) AS spread FROM (SELECT DISTINCT series FROM {train}), {s}
UNION ALL SELECT series, 'drift', s.step, sqrt(s.step * (1 + s.step / CAST(n - 1 AS DOUBLE))) FROM (SELECT DISTINCT series, n FROM {train}), {s}
UNION ALL SELECT series, 'seasonal_naive', s.step, sqrt((s.step - 1) // {SEASON} + 1) FROM (SELECT DISTINCT series FROM {train}), {s}
UNION ALL SELECT series, 'holt_damped', s.step, {summed(holt_w)} FROM {holt}, {s}
UNION ALL SELECT series, 'arima', s.step, {summed(arima_w)} FROM {arima}, {s}
UNION ALL SELECT series, 'arima_with_intervention', s.step, {summed(arima_w)} FROM {arimax}, {s}"""


R["sig"] = sigma_sql("ser", "ph", "pa", "px")
R["spr"] = spread_sql("ser", "ph", "pa", "px", AHEAD)
R["proj"] = """
SELECT p.series, p.model, CAST(p.step AS BIGINT) AS step,
       CAST(l.m1 + to_months(CAST(p.step AS INTEGER)) AS DATE) AS month, round(p.p, 2) AS tpv_inr,
       round(p.p - 1.2815515655446004e0 * sig.sigma * spr.spread, 2) AS lo80,
       round(p.p + 1.2815515655446004e0 * sig.sigma * spr.spread, 2) AS hi80
FROM (SELECT * FROM pb UNION ALL SELECT * FROM pf) p
JOIN brd ON brd.series = p.series AND brd.best_model = p.model
JOIN sig ON sig.series = p.series AND sig.model = p.model
JOIN spr ON spr.series = p.series AND spr.model = p.model AND spr.step = p.step
JOIN (SELECT series, max(month) AS m1 FROM ser GROUP BY 1) l ON l.series = p.series"""

Q["holdout_split"] = f"""
SELECT series, month, y, sr AS success_rate, {big('x')} AS x, i > n - {HOLD} AS is_test, n AS n_months,
       CASE WHEN i > n - {HOLD} THEN i - n + {HOLD} END AS step FROM ser"""
Q["low_sr_dummy"] = f"SELECT series, month, sr AS success_rate, {big('x')} AS x FROM ser"
Q["forecast_baselines"] = predictions_sql("hb")
Q["forecast_holdout"] = "SELECT * FROM pred"
Q["forecast_errors"] = "SELECT * FROM err"
Q["forecast_leaderboard"] = "SELECT * FROM brd"
Q["forecast_top_models"] = f"""
SELECT *, {big('row_number() OVER (PARTITION BY series ORDER BY mape_pct, model)')} AS rank FROM err
QUALIFY row_number() OVER (PARTITION BY series ORDER BY mape_pct, model) <= 3"""
Q["forecast_projection"] = "SELECT * FROM proj"
Q["forecast_bridge"] = """
SELECT series, max(month) AS month, arg_max(y, month) AS tpv_inr FROM ser GROUP BY series
UNION ALL SELECT series, month, tpv_inr FROM proj"""


# Rolling origins: a series at an origin `back` months before the holdout is a series of its own.
R["rser"] = "SELECT ser.*, series || '@' || u.back AS sid, u.back FROM ser, unnest(range(0, 6)) AS u(back)"
R["rtrn"] = f"SELECT sid AS series, i, y, x, n - {HOLD} - back AS n FROM rser WHERE i <= n - {HOLD} - back"
R["rb"] = baseline_sql("rtrn", HOLD)
R["rh"] = holt_sql("rtrn")
R["ra"] = arima_sql("rtrn", False)
R["rx"] = arima_sql("rtrn", True)
R["rf"] = fitted_sql("rh", "ra", "rx", HOLD, "(SELECT q.x FROM rser q WHERE q.sid = a.series AND q.i = a.n + s.step)")
R["rpred0"] = "SELECT * FROM rb UNION ALL SELECT * FROM rf"
R["rsig"] = sigma_sql("rtrn", "rh", "ra", "rx")
R["rspr"] = spread_sql("rtrn", "rh", "ra", "rx", HOLD)
R["rpred"] = f"""
SELECT q.series, h.model, CAST(q.month - to_months(CAST(h.step AS INTEGER)) AS DATE) AS origin, CAST(h.step AS BIGINT) AS step, q.month, q.y, round(h.p, 2) AS predicted,
       round(h.p - 1.2815515655446004e0 * rsig.sigma * rspr.spread, 2) AS lo80, round(h.p + 1.2815515655446004e0 * rsig.sigma * rspr.spread, 2) AS hi80
FROM rpred0 h JOIN rsig ON rsig.series = h.series AND rsig.model = h.model
JOIN rspr ON rspr.series = h.series AND rspr.model = h.model AND rspr.step = h.step
JOIN rser q ON q.sid = h.series AND q.i = q.n - {HOLD} - q.back + h.step"""
Q["forecast_coverage"] = f"""
SELECT model, step, count(*) AS points, count_if(y BETWEEN lo80 AND hi80) AS inside, {ratio('count_if(y BETWEEN lo80 AND hi80)', 'count(*)', 4)} AS coverage
FROM rpred GROUP BY 1, 2"""
Q["forecast_rolling_holdout"] = "SELECT * FROM rpred"
R["rerr"] = f"SELECT e.*, o.origins FROM ({errors_sql('rpred')}) e JOIN (SELECT series, model, count(DISTINCT origin) AS origins FROM rpred GROUP BY 1, 2) o USING (series, model)"
Q["forecast_rolling"] = "SELECT * FROM rerr"
Q["forecast_rolling_leaderboard"] = R["brd"].replace("FROM err", "FROM rerr")

# ------------------------------------------------- primitives and metrics ---
R["elig"] = "SELECT * FROM feat WHERE success_rate_3m_at_cutoff IS NOT NULL"
R["scr"] = "SELECT merchant_id, round(recency_days / (recency_days + 30.0e0), 6) AS score, churned AS y FROM elig"
R["byscore"] = "SELECT score, count_if(y = 1) AS p, count_if(y = 0) AS n FROM scr GROUP BY 1"
R["cumscore"] = """
SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp,
       coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
       sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM byscore"""
Q["ntile_scalable"] = f"""
SELECT merchant_id, attempted_txns, {big('ntile(10) OVER (ORDER BY attempted_txns, merchant_id)')} AS tile FROM feat"""
Q["first_k_months_semi"] = "SELECT month, issuer_bank, tried AS attempted_txns FROM bm SEMI JOIN early USING (month)"
Q["top_k_per_merchant"] = f"""
SELECT merchant_id, month, {rupees('tpv')} AS tpv_inr, row_number() OVER w AS rn FROM mm
WINDOW w AS (PARTITION BY merchant_id ORDER BY month DESC) QUALIFY row_number() OVER w <= 3"""
Q["share_of_total"] = f"""
SELECT issuer_bank, {ratio('sum(asked)', '(SELECT sum(asked) FROM mbm)', 6)} AS value_share FROM mbm GROUP BY 1"""
Q["hash_sample"] = """
SELECT merchant_id, category FROM mer ORDER BY md5(concat(CAST(merchant_id AS VARCHAR), ':7')), merchant_id LIMIT 400"""
Q["ewma_success_rate"] = """
WITH RECURSIVE e AS (
  SELECT merchant_id, month, tenure, sr AS now FROM dense WHERE tenure = 1
  UNION ALL
  SELECT d.merchant_id, d.month, d.tenure,
         coalesce(CASE WHEN e.now IS NULL THEN d.sr ELSE (1 - 0.55e0) * e.now + 0.55e0 * d.sr END, e.now)
  FROM e JOIN dense d ON d.merchant_id = e.merchant_id AND d.tenure = e.tenure + 1)
SELECT merchant_id, month, now AS trailing_rate FROM e"""
Q["median_by_segment"] = """
SELECT m_score, median(avg_monthly_txns) AS avg_monthly_txns, median(recency_days) AS recency_days,
       median(success_rate) AS success_rate FROM feat GROUP BY 1"""
Q["ranking_metrics"] = f"""
SELECT {big('sum(p + n)')} AS n, {big('sum(p)')} AS positives, {ratio('sum(p * (2 * below + n))', '2 * max(pos) * max(neg)', 6)} AS roc_auc,
       round(sum(CAST(p AS DOUBLE) * tp / (tp + fp)) / max(pos), 6) AS average_precision,
       round(sum(p * pow(1 - score, 2) + n * pow(score, 2)) / sum(p + n), 6) AS brier FROM cumscore"""
Q["decile_lift"] = f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM scr),
b AS (SELECT y, 1 + len(list_filter(edges[2:-2], lambda x: x < score)) AS decile FROM scr, e)
SELECT {big('decile')} AS decile, count(*) AS merchants, {ratio('sum(y)', 'count(*)', 4)} AS churn_rate,
       {ratio('sum(y) * (SELECT count(*) FROM scr)', 'count(*) * (SELECT sum(y) FROM scr)', 2)} AS lift_vs_base
FROM b GROUP BY 1"""

NUM = ["success_rate_3m_at_cutoff", "sr_trend", "avg_settlement_delay_days", "tickets_unresolved",
       "tickets_payment_failure", "tenure_months", "competitor_density", "avg_monthly_txns", "avg_monthly_tpv",
       "tpv_cv", "avg_ticket_inr", "p90_gap_days", "degraded_issuer_exposure", "avg_active_days"]
SEG = ["recency_days", "avg_monthly_tpv", "success_rate_3m_at_cutoff", "sr_trend", "avg_settlement_delay_days",
       "tickets_unresolved", "p90_gap_days", "tenure_months", "tpv_cv", "degraded_issuer_exposure"]


def imputed(columns: list[str]) -> str:
    return ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM elig)) AS {c}" for c in columns)


Q["median_imputed"] = f"SELECT merchant_id, {imputed(NUM)} FROM elig"
Q["stratified_split"] = """
SELECT merchant_id, CAST(churned AS DOUBLE) AS churned,
       row_number() OVER (PARTITION BY churned ORDER BY md5(concat(CAST(merchant_id AS VARCHAR), ':7')), merchant_id)
         <= floor(0.3e0 * count(*) OVER (PARTITION BY churned) + 0.5) AS is_test FROM elig"""
R["filled"] = f"SELECT merchant_id, {imputed(SEG)} FROM elig"
R["logs"] = "SELECT merchant_id, " + ", ".join(
    f"ln(1 + greatest({c}, 0)) AS {c}" if c in ("avg_monthly_tpv", "recency_days", "p90_gap_days") else c for c in SEG) + " FROM filled"
Q["standardised_features"] = "SELECT merchant_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 5) AS {c}"
    for c in SEG) + " FROM logs"
Q["one_hot_features"] = "SELECT merchant_id, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS \"{c}_{v}\"" for c, vs in {
        "category": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "city_tier": ["tier_2", "tier_3"],
        "acquisition_channel": ["partner_bank", "referral", "self_serve"], "device_type": ["qr_static", "soundbox"],
    }.items() for v in vs) + " FROM elig"

# ---------------------------------------------------------- driver model ---
CATS = ["category", "city_tier", "acquisition_channel", "device_type"]
R["drvf"] = f"""
SELECT e.merchant_id, CAST(e.churned AS DOUBLE) AS y, is_test, {', '.join(CATS)}, {imputed(NUM)}
FROM elig e JOIN ({Q['stratified_split']}) s USING (merchant_id)"""
R["drvl"] = """
WITH seen AS (SELECT DISTINCT c.pos, c.name, c.v FROM drvf, unnest([""" + ", ".join(
    f"{{'pos': {i}, 'name': '{c}', 'v': {c}}}" for i, c in enumerate(CATS)) + """]) AS u(c) WHERE NOT is_test AND c.v IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY v) AS k FROM seen)
SELECT row_number() OVER (ORDER BY pos, v) AS j, pos, name, v FROM ranked WHERE k > 1"""
R["drvs"] = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in NUM) + " FROM drvf WHERE NOT is_test"
# Inputs as one list for each merchant; the last one is 1, for the intercept.
R["drvx"] = f"""
WITH levels AS (SELECT list({{'pos': pos, 'v': v}} ORDER BY j) AS ls FROM drvl),
wide AS (SELECT merchant_id, y, is_test, [{', '.join(f'({c} - m_{c}) / s_{c}' for c in NUM)}] AS nums, [{', '.join(CATS)}] AS cats FROM drvf, drvs)
SELECT merchant_id, y, is_test, list_concat(nums, list_transform(ls, lambda l: CASE WHEN cats[l.pos + 1] = l.v THEN 1.0e0 ELSE 0.0e0 END), [1.0e0]) AS x
FROM wide, levels"""
R["drvn"] = "SELECT j AS i, 'num__' || name AS feature FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(NUM, start=1)) + f") AS v(j, name) UNION ALL SELECT {len(NUM)} + j, 'cat__' || name || '_' || v FROM drvl"
# Newton's method on the penalised loss (the penalty is 1, and 0 for the intercept): the curvature beside the unit matrix is
# reduced pivot by pivot, which leaves its inverse, and the weights move by the inverse times the slope.
NEWTON = 9


def newton(name: str) -> None:
    """Relations of the weights w0, w1 ... and of the inverse curvature m0, m1 ... for the inputs in relation x."""
    R[f"{name}w0"] = f"SELECT list_transform(x, lambda e: 0.0e0) AS w FROM {name}x LIMIT 1"
    for _k in range(NEWTON + 1):
        R[f"{name}c{_k}"] = f"""
WITH p AS (SELECT x, y, len(x) AS d, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM {name}x, {name}w{_k} WHERE NOT is_test),
cells AS (SELECT a.i, b.j, sum(p * (1 - p) * x[a.i] * x[b.j]) + CASE WHEN a.i = b.j AND a.i < any_value(d) THEN 1 ELSE 0 END AS h
          FROM p, unnest(range(1, d + 1)) AS a(i), unnest(range(1, d + 1)) AS b(j) GROUP BY 1, 2)
SELECT i, list(h ORDER BY j) AS h FROM cells GROUP BY 1"""
        R[f"{name}m{_k}"] = f"""
WITH RECURSIVE g AS (
  SELECT 1 AS k, list(list_concat(h, list_transform(h, lambda e, c: CASE WHEN c = i THEN 1.0e0 ELSE 0.0e0 END)) ORDER BY i) AS m FROM {name}c{_k}
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda e: e / r[k])
                                               ELSE list_transform(r, lambda e, c: e - r[k] * m[k][c] / m[k][k]) END)
  FROM g WHERE k <= len(m))
SELECT list_transform(m, lambda r: r[len(m) + 1:]) AS inv FROM g WHERE k = len(m) + 1"""
        R[f"{name}w{_k + 1}"] = f"""
WITH p AS (SELECT x, y, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM {name}x, {name}w{_k} WHERE NOT is_test),
slopes AS (SELECT a.i, sum((p - y) * x[a.i]) AS s FROM p, unnest(range(1, len(x) + 1)) AS a(i) GROUP BY 1),
slope AS (SELECT list(s + CASE WHEN i < len(w) THEN w[i] ELSE 0 END ORDER BY i) AS g FROM slopes, {name}w{_k})
SELECT list_transform(w, lambda e, i: e - list_dot_product(inv[i], g)) AS w FROM {name}w{_k}, slope, {name}m{_k}"""


newton("drv")
REACH = "1.959963984540054e0"
R["drvt"] = f"""
SELECT feature, w[i] AS coef, sqrt(inv[i][i]) AS se FROM drvn, drvw{NEWTON}, drvm{NEWTON}"""
Q["driver_coefficients"] = f"""
SELECT feature, round(coef, 6) AS coef, round(se, 6) AS std_err, round(exp(coef), 6) AS odds_ratio, round(exp(coef - se * {REACH}), 6) AS ci_low,
       round(exp(coef + se * {REACH}), 6) AS ci_high, round(coef / se, 6) AS z, abs(coef / se) > {REACH} AS significant FROM drvt"""
R["drvp"] = f"SELECT merchant_id, y, is_test, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM drvx, drvw{NEWTON}"
Q["driver_scores"] = "SELECT merchant_id, y AS churned, is_test, score FROM drvp"
R["drvh"] = "SELECT merchant_id, score, CAST(y AS INTEGER) AS y FROM drvp WHERE is_test"
R["byprob"] = R["byscore"].replace("FROM scr", "FROM drvh")
R["cumprob"] = R["cumscore"].replace("FROM byscore", "FROM byprob")
Q["driver_metrics"] = f"""
SELECT 'logistic' AS model, (SELECT count_if(NOT is_test) FROM drvp) AS n_train, (SELECT count_if(is_test) FROM drvp) AS n_test,
       (SELECT round(avg(y), 4) FROM drvp) AS base_rate, roc_auc, average_precision, brier
FROM ({Q['ranking_metrics'].replace('FROM cumscore', 'FROM cumprob')})"""
Q["driver_lift"] = Q["decile_lift"].replace("FROM scr", "FROM drvh")
# The expected sign of each driver.
SIGNS = {"success_rate_3m_at_cutoff": -1, "avg_settlement_delay_days": 1, "tickets_unresolved": 1, "tenure_months": -1,
         "competitor_density": 1, "avg_monthly_txns": -1}
Q["sign_recovery"] = f"""
SELECT name AS feature, CASE WHEN want > 0 THEN '+' ELSE '-' END AS expected_sign, round(coef, 4) AS recovered_coef,
       CASE WHEN coef > 0 THEN '+' ELSE '-' END AS recovered_sign, (coef > 0) = (want > 0) AS sign_matches, abs(coef / se) > {REACH} AS significant
FROM drvt JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in SIGNS.items())}) AS e(name, want) ON feature = 'num__' || name"""
EFFECTS = f"""
SELECT substr(feature, 6) AS driver, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio,
       round(exp(coef + se * {REACH}) - exp(coef), 6) AS reach_up, round(exp(coef) - exp(coef - se * {REACH}), 6) AS reach_down
FROM drvt WHERE %s ORDER BY abs(drvt.coef) DESC LIMIT 12"""
Q["top_drivers"] = EFFECTS % f"abs(coef / se) > {REACH}"
Q["largest_effects"] = EFFECTS % "TRUE"

# -------------------------------------------------------- temporal split ---
CUTS, CUT_STEP, CUT_WIDTH = 4, 180, 90
R["cuts"] = f"SELECT d1 - {OUTCOME} - CAST({CUT_STEP} * u.k AS INTEGER) AS cutoff, u.k = 0 AS is_test FROM span, unnest(range(0, {CUTS})) AS u(k)"
# Inputs of a cutoff are made from the attempts up to it alone, the outcome from those after it.
R["cuttx"] = "SELECT cutoff, is_test, tx.* FROM cuts JOIN tx ON txn_date <= cutoff"
R["cutin"] = f"""
WITH cells AS (SELECT DISTINCT merchant_id, cutoff, txn_date, issuer_bank FROM cuttx WHERE txn_date > cutoff - {CUT_WIDTH}),
c AS (SELECT merchant_id, cutoff, count(*) AS cells FROM cells GROUP BY 1, 2),
a AS (SELECT merchant_id, cutoff, any_value(is_test) AS is_test, min(txn_date) AS first, max(txn_date) FILTER (ok) AS won_at,
             count_if(txn_date > cutoff - {CUT_WIDTH}) AS tried, count_if(ok AND txn_date > cutoff - {CUT_WIDTH}) AS won,
             coalesce(sum(paise) FILTER (ok AND txn_date > cutoff - {CUT_WIDTH}), 0) AS tpv,
             count_if(txn_date <= cutoff - {CUT_WIDTH} AND txn_date > cutoff - 2 * {CUT_WIDTH}) AS tried0,
             count_if(ok AND txn_date <= cutoff - {CUT_WIDTH} AND txn_date > cutoff - 2 * {CUT_WIDTH}) AS won0
      FROM cuttx GROUP BY 1, 2)
SELECT merchant_id, cutoff, is_test, {big('cutoff - coalesce(won_at, first)')} AS recency_days, {big('cutoff - first')} AS tenure_days,
       {big('tried')} AS attempted_txns, {big('cells')} AS active_issuer_days, {ratio('won', 'tried', 6)} AS success_rate,
       coalesce({ratio('won', 'tried', 6)} - {ratio('won0', 'tried0', 6)}, 0) AS success_trend, {rupees('tpv')} AS tpv_inr
FROM a JOIN c USING (merchant_id, cutoff)"""
R["cutout"] = f"""
SELECT DISTINCT merchant_id, cutoff FROM cuts JOIN tx ON ok AND txn_date > cutoff AND txn_date <= cutoff + {OUTCOME}"""
R["tmp"] = """
SELECT i.*, CAST(o.merchant_id IS NULL AS INTEGER) AS churned FROM cutin i LEFT JOIN cutout o USING (merchant_id, cutoff)"""
Q["temporal_features"] = "SELECT * FROM tmp"
TEMPORAL = ["recency_days", "tenure_days", "attempted_txns", "active_issuer_days", "success_rate", "success_trend", "tpv_inr"]
R["tmpx"] = f"""
WITH s AS (SELECT {', '.join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in TEMPORAL)}
           FROM tmp WHERE NOT is_test)
SELECT merchant_id, cutoff, CAST(churned AS DOUBLE) AS y, is_test, [{', '.join(f'({c} - m_{c}) / s_{c}' for c in TEMPORAL)}, 1.0e0] AS x FROM tmp, s"""
newton("tmp")
R["tmpp"] = f"SELECT merchant_id, cutoff, y, is_test, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM tmpx, tmpw{NEWTON}"
Q["temporal_scores"] = "SELECT merchant_id, cutoff, y AS churned, is_test, score FROM tmpp"
R["bytmp"] = R["byscore"].replace("FROM scr", "FROM tmpp WHERE is_test")
R["cumtmp"] = R["cumscore"].replace("FROM byscore", "FROM bytmp")
Q["temporal_metrics"] = f"""
SELECT (SELECT count_if(NOT is_test) FROM tmpp) AS n_train, (SELECT count_if(is_test) FROM tmpp) AS n_test,
       (SELECT round(avg(y) FILTER (NOT is_test), 4) FROM tmpp) AS train_base_rate, (SELECT round(avg(y) FILTER (is_test), 4) FROM tmpp) AS test_base_rate,
       roc_auc, average_precision, brier
FROM ({Q['ranking_metrics'].replace('FROM cumscore', 'FROM cumtmp')})"""

R["seg"] = "SELECT *, CAST(m_score - 1 AS BIGINT) AS segment_id FROM elig"
PROF = ["avg_monthly_tpv", "avg_monthly_txns", "success_rate_3m_at_cutoff", "sr_trend", "recency_days",
        "tenure_months", "p90_gap_days", "tickets_unresolved", "degraded_issuer_exposure"]
R["segp"] = f"""
SELECT segment_id, count(*) AS merchants, {', '.join(f'median({c}) AS {c}' for c in PROF)},
       {ratio('sum(churned)', 'count(*)', 6)} AS churn_rate, sum(CAST(round(avg_monthly_tpv * 100) AS BIGINT)) AS t
FROM seg GROUP BY 1"""
# The six names and the order in which they apply.
R["segn"] = f"""
WITH pop AS (SELECT {', '.join(f'median({c}) AS {c}' for c in SEG)} FROM seg),
f AS (SELECT s.*, coalesce(s.avg_monthly_tpv > pop.avg_monthly_tpv, FALSE) AS large,
             coalesce(s.success_rate_3m_at_cutoff < pop.success_rate_3m_at_cutoff, FALSE) AS poor, coalesce(s.sr_trend < 0, FALSE) AS falling,
             coalesce(s.recency_days > pop.recency_days, FALSE) AS stale, coalesce(s.tenure_months < pop.tenure_months, FALSE) AS young FROM segp s, pop)
SELECT *, CASE
  WHEN large AND poor AND falling THEN 'High-value, payments-impaired'
  WHEN large AND NOT poor THEN 'Core healthy volume'
  WHEN stale AND NOT large THEN 'Fading long-tail'
  WHEN young AND NOT stale THEN 'New and ramping'
  WHEN poor THEN 'Low-volume, poor experience'
  ELSE 'Steady long-tail' END AS label FROM f"""
Q["segment_naming"] = f"""
SELECT segment_id, label || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS segment_name,
       merchants, {', '.join(PROF)}, churn_rate, {ratio('t', 'sum(t) OVER ()', 4)} AS tpv_share
FROM segn WINDOW w AS (PARTITION BY label ORDER BY segment_id)"""

R["pts"] = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
Q["silhouette_labelled"] = f"""
WITH dims AS (SELECT label, i, sum(v[i]) AS s FROM pts, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY 1, 2),
sums AS (SELECT label, list(s ORDER BY i) AS s FROM dims GROUP BY 1),
groups AS (SELECT label, count(*) AS n, sum(list_dot_product(v, v)) AS q FROM pts GROUP BY 1),
d AS (SELECT p.vec_id, p.label, g.label = p.label AS mine,
        greatest((list_dot_product(p.v, p.v) * n + q - 2 * list_dot_product(p.v, s)) / nullif(n - CAST(g.label = p.label AS INT), 0), 0) AS m
      FROM pts p, groups g JOIN sums USING (label)),
w AS (SELECT vec_id, label, min(m) FILTER (mine) AS a, min(m) FILTER (NOT mine) AS b FROM d GROUP BY 1, 2)
SELECT {big('label')} AS label, count(*) AS points, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 5) AS silhouette
FROM w GROUP BY label"""


def short_money(x: str) -> str:
    return (f"CASE WHEN abs({x}) >= 1e9 THEN printf('₹%.2fB', {x} / 1e9) WHEN abs({x}) >= 1e6 THEN printf('₹%.1fM', {x} / 1e6) "
            f"WHEN abs({x}) >= 1e3 THEN printf('₹%.0fK', {x} / 1e3) ELSE printf('₹%.0f', {x}) END")


Q["kpi_row"] = f"""
WITH k AS (SELECT {big('(SELECT sum(tried) FROM bm)')} AS attempts, {rupees('(SELECT sum(tpv) FROM nh)')} AS tpv_inr,
             (SELECT arg_max(live, month) FROM nh) AS active_merchants,
             {ratio("(SELECT count_if(silent >= 65) FROM cs JOIN rr USING (merchant_id))", '(SELECT count(*) FROM cs)', 4)} AS confirmed_churn_rate,
             (SELECT annualised_revenue_at_risk FROM rar WHERE status = 'at_risk') AS revenue_at_risk)
SELECT *, {short_money('tpv_inr')} AS tpv_text, {short_money('revenue_at_risk')} AS revenue_at_risk_text FROM k"""


def triangle_sql(width: int) -> str:
    return "SELECT cohort_month, " + ", ".join(
        f"max(CASE WHEN month_index = {i} THEN logo_retention END) AS m{i}" for i in range(width)) + " FROM coh GROUP BY 1"


def heatmap_sql(months: list[str]) -> str:
    return "SELECT issuer_bank, " + ", ".join(
        f"max(CASE WHEN strftime(month, '%Y_%m') = '{m}' THEN sr END) AS \"{m}\"" for m in months) + " FROM bm GROUP BY 1"


# Columns for the calendar of the folders from sf0.01 on; tests write those of another calendar.
MONTHS = 83
Q["cohort_triangle_pivot"] = triangle_sql(MONTHS)
Q["issuer_month_heatmap"] = heatmap_sql([f"{1995 + i // 12}_{i % 12 + 1:02d}" for i in range(MONTHS)])
Q["flow_series"] = f"""
SELECT month, 'new' AS flow, {big('fresh')} AS merchants FROM nh WHERE edge = 0
UNION ALL SELECT month, 'reactivated', back FROM nh WHERE edge = 0
UNION ALL SELECT month, 'went_silent', -quiet FROM nh WHERE edge = 0
UNION ALL SELECT month, 'net', fresh + back - quiet FROM nh WHERE edge = 0"""
Q["issuer_ranking"] = """
SELECT issuer_bank, avg_success_rate, avg_volume_share, cumulative_rate_effect, rank_by_worst_sr, rank_by_network_impact FROM rank"""
Q["growth_vs_m3"] = f"""
SELECT nh.month, nh.live AS active_merchants, {rupees('nh.tpv')} AS tpv_inr, c.logo_retention AS m3_logo_retention,
       c.tpv_retention AS m3_tpv_retention
FROM nh LEFT JOIN (SELECT * FROM coh WHERE month_index = 3) c ON c.cohort_month = nh.month"""
Q["failure_reason_mix_for_issuer"] = f"""
SELECT month, failure_reason, failures, reason_share FROM ({Q['failure_reason_mix']})
WHERE issuer_bank = (SELECT issuer_bank FROM worst)"""
Q["sr_sliced"] = f"""
SELECT txn_month AS month, count(*) AS attempted_txns, count_if(ok) AS successful_txns,
       {ratio('count_if(ok)', 'count(*)', 6)} AS success_rate
FROM tx SEMI JOIN (SELECT merchant_id FROM mer WHERE city_tier = 'tier_3' AND category = 'BUILDING') m USING (merchant_id)
GROUP BY 1"""
Q["export_headlines"] = f"""
SELECT {rupees('sum(tpv)')} AS total_tpv_inr, {ratio(f"sum({micro('sr')})", '1000000 * count(*)', 6)} AS average_success_rate,
       min(sr) AS lowest_success_rate, max(live) AS peak_active_merchants, count_if(sr < 0.92) AS months_below_threshold FROM nh"""

Q["check_flow_identity"] = """
SELECT 'flow_identity' AS check_name, count_if(fresh + back - quiet <> live - live0) AS violations FROM nh"""
Q["check_rate_bounds"] = "SELECT 'rate_bounds' AS check_name, count_if(sr < 0 OR sr > 1) AS violations FROM mm"
Q["check_tpv_bound"] = "SELECT 'tpv_bound' AS check_name, count_if(tpv > asked + 1) AS violations FROM mm"
# Features rebuilt from sources that end where the label window starts: every relation between them and the sources, again.
REBUILT = ["tx", "tk", "st", "span", "mbm", "mm", "dense", "gap", "bm", "early", "srb", "con", "rank", "worst", "expo", "feat0", "feat"]
CUT_BY = {"tx": "txn_date", "tk": "ticket_month", "st": "settle_month"}


def rebuilt(body: str) -> str:
    """`body` over the rebuilt relations, under their usual names."""
    def swap(m: re.Match) -> str:
        word = re.match(r"\s+(\w+)", body[m.end():])
        named = word and word[1].upper() not in ("WHERE", "GROUP", "SEMI", "LEFT", "JOIN", "CROSS", "QUALIFY", "ORDER", "USING", "ON", "WINDOW")
        return f"{m[1]} {m[2]}_c" + ("" if named else f" AS {m[2]}")
    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(REBUILT)})\b", swap, body)


for _name in REBUILT:
    R[f"{_name}_c"] = f"SELECT {_name}.* FROM {_name}, cut WHERE {CUT_BY[_name]} < cut.l0" if _name in CUT_BY else rebuilt(R[_name])
Q["check_no_leak"] = """
WITH a AS (SELECT * EXCLUDE (churned, r_score, f_score, m_score) FROM feat),
b AS (SELECT * EXCLUDE (churned, r_score, f_score, m_score) FROM feat_c)
SELECT 'no_leak' AS check_name, count(*) AS violations
FROM (SELECT * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))"""
Q["check_recency_cardinality"] = f"""
SELECT 'recency_varies' AS check_name, {big("CASE WHEN count(DISTINCT recency_days) > 50 THEN 0 ELSE 1 END")} AS violations FROM feat"""
Q["check_exposure_sums"] = f"""
SELECT 'exposure_sums' AS check_name, count_if(abs(s - 1000000) > 100) AS violations
FROM (SELECT sum({micro('exposure_share')}) AS s FROM expo GROUP BY merchant_id)"""
Q["check_definitions_disagree"] = f"""
SELECT 'definitions_disagree' AS check_name, {big('CASE WHEN sum(d1f) = sum(d2f) THEN 1 ELSE 0 END')} AS violations FROM cs"""
Q["check_contribution_closes"] = """
WITH net AS (SELECT DISTINCT net0 FROM srb),
grid AS (SELECT m.month, i.issuer_bank FROM (SELECT DISTINCT month FROM bm) m, (SELECT issuer_bank FROM bm UNION SELECT issuer_bank FROM srb) i),
filled AS (SELECT month, coalesce(bm.share, 0) AS share, coalesce(srb.share0, 0) AS share0,
                  coalesce(bm.sr, srb.sr0) AS sr, coalesce(srb.sr0, bm.sr) AS sr0, con.rate_effect + con.mix_effect + con.interaction_effect AS known
           FROM grid LEFT JOIN bm USING (month, issuer_bank) LEFT JOIN srb USING (issuer_bank) LEFT JOIN con USING (month, issuer_bank)),
parts AS (SELECT month, sum(coalesce(known, share0 * (sr - sr0) + (share - share0) * (sr0 - net0) + (share - share0) * (sr - sr0))) AS s FROM filled, net GROUP BY month),
whole AS (SELECT month, CAST(sum(won) AS DOUBLE) / sum(tried) - any_value(net0) AS d FROM bm, net GROUP BY month)
SELECT 'contribution_closes' AS check_name, count_if(abs(s - d) > 0.0001) AS violations FROM parts JOIN whole USING (month)"""

Q["transactions_by_month_part"] = Q["transactions_typed"]
Q["export_health_csv"] = """
SELECT strftime(month, '%Y-%m-%d') AS month, live AS active_merchants, sr AS success_rate FROM nh"""
# Columns of the exported marts: d is a date, f a double, any other letter a text or a whole number.
EXPORTS = {
    "network_health_monthly": "month:d active_merchants:n new_merchants:n reactivated_merchants:n went_silent_merchants:n churned_merchants:n tpv_inr:f "
                              "success_rate:f failed_value_inr:f tickets_raised:n tpv_per_active_merchant:f merchant_mom_growth:f tpv_mom_growth:f "
                              "net_merchant_adds:n is_censored_boundary:n",
    "cohort_retention": "cohort_month:d activity_month:d month_index:n cohort_size:n active_merchants:n logo_retention:f tpv_inr:f tpv_retention:f",
    "bank_month_sr": "month:d issuer_bank:t attempted_txns:n successful_txns:n success_rate:f attempted_value_inr:f failed_value_inr:f volume_share:f",
    "sr_contribution": "month:d issuer_bank:t success_rate:f sr_baseline:f volume_share:f share_baseline:f sr_delta:f rate_effect:f mix_effect:f "
                       "interaction_effect:f failed_value_inr:f",
    "revenue_at_risk": "status:t merchants:n monthly_tpv_at_risk:f annualised_revenue_at_risk:f avg_issuer_exposure:f attributable_revenue_at_risk:f",
    "realised_failure_loss": "month:d failed_value_inr:f revenue_lost_inr:f success_rate:f excess_revenue_lost_inr:f",
    "incident_culprit_ranking": "issuer_bank:t avg_success_rate:f avg_volume_share:f worst_sr_delta:f cumulative_rate_effect:f total_failed_value_inr:f "
                                "rank_by_worst_sr:n rank_by_network_impact:n",
    "exposure_vs_churn": "exposure_decile:n min_exposure:f max_exposure:f merchants:n churn_rate:f tier3_share:f avg_sr_at_cutoff:f",
    "cohort_m3_retention": "cohort_month:d cohort_size:n m3_logo_retention:f m3_tpv_retention:f",
}


def digest_sql(mart: str, columns: str) -> str:
    as_text = {"d": "strftime({}, '%Y-%m-%d')", "f": "CAST(CAST(round({} * 1000000.0) AS BIGINT) AS VARCHAR)"}
    shown = [f"coalesce({as_text.get(kind, 'CAST({} AS VARCHAR)').format(c)}, '~')" for c, kind in sorted(x.split(":") for x in columns.split())]
    row = " || '|' || ".join(shown)
    return (f"SELECT '{mart}' AS mart, count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(md5({row}), 1, 8) AS BIGINT)), 0) AS BIGINT) AS content "
            f"FROM ({Q[mart]})")


Q["export_marts"] = "\nUNION ALL ".join(digest_sql(mart, columns) for mart, columns in EXPORTS.items())
Q["manifest"] = """
SELECT 'customer' AS table_name, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_parts, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns FROM customer
UNION ALL SELECT 'lineitem', count(*), 1, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' FROM lineitem
UNION ALL SELECT 'nation', count(*), 1, 'n_nationkey,n_name,n_regionkey' FROM nation
UNION ALL SELECT 'orders', count(*), 1, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' FROM orders
UNION ALL SELECT 'supplier', count(*), 1, 's_suppkey,s_name,s_nationkey,s_acctbal' FROM supplier"""
Q["transactions_sample"] = f"""
SELECT merchant_id, txn_date, issuer_bank, {rupees('paise')} AS amount_inr FROM tx
ORDER BY txn_date, merchant_id, issuer_bank, paise LIMIT 2000"""
Q["merchants_sample"] = "SELECT merchant_id, category, city_tier, state, gst_registered FROM mer ORDER BY merchant_id LIMIT 500"
Q["impact_order"] = "SELECT month, issuer_bank, rate_effect, rank() OVER (ORDER BY abs(rate_effect) DESC NULLS LAST) AS impact_rank FROM con"
R["known"] = """
SELECT cs.*, c_acctbal < 0 AS actual, c_acctbal BETWEEN 0 AND 1000 AS dormant FROM cs JOIN customer ON c_custkey = merchant_id"""
Q["lifecycle_status"] = f"""
SELECT merchant_id, {big('d1f')} AS churn_d1_naive, {big('d2f')} AS churn_d2_adaptive, {big('d3f')} AS churn_d3_value_decay, actual, dormant FROM known"""
Q["rule_score_known"] = Q["rule_score"].replace("FROM past", "FROM known")
Q["sr_sliced_issuer"] = f"""
SELECT txn_month AS month, count(*) AS attempted_txns, count_if(ok) AS successful_txns,
       {ratio('count_if(ok)', 'count(*)', 6)} AS success_rate
FROM tx SEMI JOIN (SELECT merchant_id FROM mer WHERE city_tier = 'tier_1') m USING (merchant_id)
WHERE issuer_bank = (SELECT issuer_bank FROM worst) GROUP BY 1"""
Q["adhoc_sql"] = f"SELECT category, count(*) AS merchants, {big('sum(d1f)')} AS silent FROM cs GROUP BY 1"


# The network as one series.
R["nser"] = f"""
WITH e AS (SELECT CAST(CASE WHEN day(d1 + 1) = 1 THEN date_trunc('month', d1)
                            ELSE date_trunc('month', d1) - INTERVAL 1 MONTH END AS DATE) AS m1 FROM span)
SELECT 'network' AS series, month, {rupees('tpv')} AS y, CASE WHEN sr < {LOW} THEN 1 ELSE 0 END AS x,
       row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS n
FROM nh, e WHERE month <= e.m1"""
R["ntrn"] = f"SELECT series, i, y, x, n - {HOLD} AS n FROM nser WHERE i <= n - {HOLD}"
R["nhb"] = baseline_sql("ntrn", HOLD)
R["nhh"] = holt_sql("ntrn")
R["nha"] = arima_sql("ntrn", False)
R["nhx"] = arima_sql("ntrn", True)
R["nhf"] = fitted_sql("nhh", "nha", "nhx", HOLD,
                      "(SELECT q.x FROM nser q WHERE q.series = a.series AND q.i = a.n + s.step)")
R["npred0"] = "SELECT * FROM nhb UNION ALL SELECT * FROM nhf"
R["npred"] = predictions_sql("npred0", "nser")
R["nerr"] = errors_sql("npred")
Q["forecast_network"] = "SELECT * FROM nerr"
# Parts of the scorecards: the query that each one holds, and its columns as in EXPORTS.
CONFUSION = "tp:n fp:n fn:n tn:n flagged:n precision:f recall:f f1:f"
CARDS = {
    "churn_scorecard": {
        "summary": ("evaluation_summary", "merchants_scored:n true_churn_rate:f precision_ceiling:f"),
        "false_positives": ("false_positive_profile", "false_positives:n of_which_dormant:n share_dormant:f median_p90_gap_fp:f median_p90_gap_population:f"),
        "rules": ("best_rules", f"rule:t setting:f {CONFUSION}"), "tiers": ("two_tier_point", f"tier:t window_days:n {CONFUSION}"),
        "fixed_sweep": ("fixed_window_sweep", f"window_days:n {CONFUSION}"),
        "adaptive_sweep": ("adaptive_sweep", f"multiplier:f median_threshold_days:f {CONFUSION}")},
    "forecast_scorecard": {
        "series": ("forecast_leaderboard", "series:t best_model:t best_mape_pct:f naive_mape_pct:f models:n beats_naive:t"),
        "scores": ("forecast_errors", "series:t model:t mape_pct:f mae_inr:f"),
        "forecast": ("forecast_projection", "series:t model:t step:n month:d tpv_inr:f lo80:f hi80:f")},
    "driver_scorecard": {
        "logistic": ("driver_metrics", "model:t n_train:n n_test:n base_rate:f roc_auc:f average_precision:f brier:f"),
        "coefficient_recovery": ("sign_recovery", "feature:t expected_sign:t recovered_coef:f recovered_sign:t sign_matches:t significant:t"),
        "decile_lift": ("driver_lift", "decile:n merchants:n churn_rate:f lift_vs_base:f"),
        "coefficients": ("driver_coefficients", "feature:t coef:f std_err:f odds_ratio:f ci_low:f ci_high:f z:f significant:t")},
}
for _card, _parts in CARDS.items():
    Q[_card] = "\nUNION ALL ".join(
        digest_sql(query, columns).replace(f"'{query}' AS mart", f"'{part}' AS part", 1) for part, (query, columns) in _parts.items())
Q["mart_row_counts"] = "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {rel}" for name, rel in {
        "merchant_month": "mm", "merchant_month_dense": "dense", "merchant_activity_gaps": "gap",
        "merchant_churn_status": "cs", "cohort_retention": "coh", "network_health_monthly": "nh",
        "bank_month_sr": "bm", "sr_contribution": "con",
        "failure_reason_mix": "(SELECT DISTINCT txn_month, issuer_bank, reason FROM tx WHERE NOT ok)",
        "merchant_bank_exposure": "expo", "realised_failure_loss": "nh", "revenue_at_risk": "rar",
        "asof_status": "past", "fixed_window_sweep": "fx", "adaptive_sweep": "ad", "issuer_series": "ser",
        "forecast_holdout": "pred", "forecast_projection": "proj"}.items())
