"""SQL for a second engine, one statement per registered query.

The statements state each rule directly (self-joins, row numbers, joins on
raw rows) and share no shortcut with the Spark plans.
"""

from __future__ import annotations

_SALES = """
sales AS (
  SELECT l_orderkey AS transaction_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
         n_regionkey + 101 AS branch_id, r_name AS branch_name,
         l_partkey AS product_id, l_suppkey AS employee_id, o_custkey AS customer_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,4)) AS gross,
         CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS discount,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS net
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category, p_type AS section,
         CAST(ascii(p_type) * 100 + length(p_type) AS INTEGER) AS section_id,
         CAST((p_retailprice - 900) * 2 AS DECIMAL(18,4)) AS price,
         CAST(CAST((p_retailprice - 900) * 2 AS DECIMAL(18,4)) * (4 + p_size % 5) / 10 AS DECIMAL(18,4)) AS cost
  FROM part
),
customers AS (
  SELECT c_custkey AS customer_id, 1965 + c_custkey % 50 AS birth_year,
         CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS DATE) AS join_date
  FROM customer
),
banded AS (
  SELECT customer_id, join_date,
         CASE WHEN 2026 - birth_year BETWEEN 19 AND 27 THEN 'Young'
              WHEN 2026 - birth_year BETWEEN 28 AND 40 THEN 'Middle'
              WHEN 2026 - birth_year BETWEEN 41 AND 55 THEN 'Adult' END AS band,
         CASE WHEN 2026 - birth_year BETWEEN 19 AND 27 THEN 'Young (19-27)'
              WHEN 2026 - birth_year BETWEEN 28 AND 40 THEN 'Middle (28-40)'
              WHEN 2026 - birth_year BETWEEN 41 AND 55 THEN 'Adult (41-55)' END AS age_segment
  FROM customers WHERE 2026 - birth_year BETWEEN 19 AND 55
),
inventory AS (
  SELECT r_regionkey + 101 AS branch_id, p_partkey AS product_id,
         CAST((r_regionkey + length(p_type)) % 3 * 3 + p_partkey % 3 AS INTEGER) AS floor_qty,
         CAST(1 + (p_partkey * 13 + r_regionkey * 5) % 200 AS INTEGER) AS total_qty
  FROM region CROSS JOIN part
),
purchases AS (
  SELECT event_id AS transaction_id, ts, CAST(ts AS DATE) AS day, user_id AS customer_id,
         CAST(user_id % 5 + 101 AS INTEGER) AS branch_id, user_id % 25 AS employee_id, 1 AS quantity,
         CAST(value AS DECIMAL(18,4)) AS gross, CAST(value AS DECIMAL(18,4)) AS net
  FROM events WHERE event_type = 'purchase'
)
"""

_SEASON = """CASE WHEN month(ts) BETWEEN 1 AND 3 THEN 'Winter' WHEN month(ts) BETWEEN 4 AND 6 THEN 'Spring'
     WHEN month(ts) BETWEEN 7 AND 9 THEN 'Summer' ELSE 'Fall' END"""

_TIER = """CASE WHEN price < 25 THEN 'Budget' WHEN price <= 45 THEN 'Standard' WHEN price <= 80 THEN 'Upper'
     WHEN price <= 150 THEN 'Premium' ELSE 'Luxury' END"""

_HOLIDAYS = """
ranges(priority, event, s, e) AS (VALUES
  (1, 'Eid Al-Fitr Season', TIMESTAMP '1996-02-10', TIMESTAMP '1996-02-24'),
  (1, 'Eid Al-Fitr Season', TIMESTAMP '1997-01-30', TIMESTAMP '1997-02-13'),
  (1, 'Eid Al-Fitr Season', TIMESTAMP '1998-01-20', TIMESTAMP '1998-02-03'),
  (1, 'Eid Al-Fitr Season', TIMESTAMP '1999-03-10', TIMESTAMP '1999-03-22'),
  (2, 'Eid Al-Adha Season', TIMESTAMP '1996-04-18', TIMESTAMP '1996-05-02'),
  (2, 'Eid Al-Adha Season', TIMESTAMP '1997-04-08', TIMESTAMP '1997-04-22'),
  (2, 'Eid Al-Adha Season', TIMESTAMP '1998-03-28', TIMESTAMP '1998-04-11'),
  (3, 'Christmas Season', TIMESTAMP '1995-12-11', TIMESTAMP '1995-12-25'),
  (3, 'Christmas Season', TIMESTAMP '1996-12-15', TIMESTAMP '1996-12-30'),
  (3, 'Christmas Season', TIMESTAMP '1997-12-15', TIMESTAMP '1997-12-30'),
  (3, 'Christmas Season', TIMESTAMP '1998-12-15', TIMESTAMP '1998-12-30'),
  (4, 'Mother''s Day Focus', TIMESTAMP '1997-03-15', TIMESTAMP '1997-03-22'),
  (4, 'Mother''s Day Focus', TIMESTAMP '1998-03-15', TIMESTAMP '1998-03-22'),
  (4, 'Mother''s Day Focus', TIMESTAMP '1999-03-15', TIMESTAMP '1999-03-24')
),
labelled AS (
  SELECT sales.*, coalesce((SELECT max_by(event, priority) FROM ranges WHERE ts BETWEEN s AND e),
                           'Regular Days') AS event
  FROM sales
),
holidays AS (
  SELECT year(ts) AS year, event, CAST(sum(quantity) AS BIGINT) AS quantity,
         CAST(sum(net) AS DOUBLE) AS net_amount
  FROM labelled GROUP BY 1, 2
)
"""


def _rfm(source: str) -> str:
    return f"""
kept AS (
  SELECT customer_id, ts, net FROM {source}
  WHERE customer_id IS NOT NULL AND ts >= (SELECT max(ts) - INTERVAL 30 DAY FROM {source})
),
activity AS (
  SELECT customer_id,
         CAST(floor(epoch((SELECT max(ts) FROM kept) - max(ts)) / 86400) AS BIGINT) AS recency,
         count(*) AS frequency, CAST(sum(net) AS DOUBLE) AS monetary
  FROM kept GROUP BY customer_id
),
edges AS (
  SELECT quantile_cont(CAST(recency AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS r,
         quantile_cont(CAST(frequency AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS f,
         quantile_cont(monetary, [0, 0.25, 0.5, 0.75, 1]) AS m
  FROM activity
),
parts AS (
  SELECT activity.*,
         CASE WHEN len(list_distinct(r)) < 5 THEN 2.0 WHEN recency <= r[2] THEN 4 WHEN recency <= r[3] THEN 3
              WHEN recency <= r[4] THEN 2 ELSE 1 END AS rs,
         CASE WHEN len(list_distinct(f)) < 5 THEN 2.0 WHEN frequency <= f[2] THEN 1 WHEN frequency <= f[3] THEN 2
              WHEN frequency <= f[4] THEN 3 ELSE 4 END AS fs,
         CASE WHEN len(list_distinct(m)) < 5 THEN 2.0 WHEN monetary <= m[2] THEN 1 WHEN monetary <= m[3] THEN 2
              WHEN monetary <= m[4] THEN 3 ELSE 4 END AS ms
  FROM activity CROSS JOIN edges
),
rfm AS (
  SELECT customer_id, recency, frequency, monetary, CAST(rs AS DOUBLE) AS recency_score,
         CAST(fs AS DOUBLE) AS frequency_score, CAST(ms AS DOUBLE) AS monetary_score,
         CAST(rs + fs + ms AS DOUBLE) AS rfm_score,
         CASE WHEN rs + fs + ms >= 10 THEN 'Champions' WHEN rs + fs + ms >= 7 THEN 'Loyal'
              WHEN rs + fs + ms >= 5 THEN 'At-Risk' ELSE 'Lost' END AS segment
  FROM parts
)
"""


_TRIGGER = """
daily AS (SELECT day, CAST(sum(net) AS DOUBLE) AS net_amount FROM sales GROUP BY day),
pairs AS (
  SELECT d.day, h.day AS hist_day, h.net_amount AS hist_net,
         row_number() OVER (PARTITION BY d.day ORDER BY h.day DESC) AS rn
  FROM daily d JOIN daily h
    ON isodow(h.day) = isodow(d.day) AND h.day < d.day AND h.day >= d.day - 44
),
hist AS (SELECT * FROM pairs WHERE rn <= 5),
stats AS (
  SELECT day, count(*) AS n, avg(hist_net) AS m, stddev_pop(hist_net) AS s FROM hist GROUP BY day
),
trig AS (
  SELECT d.day, d.net_amount, coalesce(n, 0) AS n, m, s,
         CASE WHEN m > 0 THEN (m - d.net_amount) / m WHEN m IS NOT NULL THEN 0 END AS drop_pct
  FROM daily d LEFT JOIN stats USING (day)
),
flagged AS (
  SELECT * FROM trig WHERE coalesce(drop_pct > 0.35 OR net_amount < m - 2 * s, false)
),
refs AS (
  SELECT f.day, f.n, h.hist_day AS ref_day FROM flagged f JOIN hist h USING (day)
  UNION ALL SELECT day, n, day FROM flagged
),
branch_falls AS (
  SELECT r.day, s.branch_id, s.branch_name,
         CAST(sum(CASE WHEN r.ref_day < r.day THEN net ELSE 0 END) AS DOUBLE) / max(n) AS avg_same_day,
         CAST(sum(CASE WHEN r.ref_day = r.day THEN net ELSE 0 END) AS DOUBLE) AS day_net
  FROM refs r JOIN sales s ON s.day = r.ref_day GROUP BY ALL
),
branch_drops AS (
  SELECT *, (avg_same_day - day_net) / avg_same_day AS branch_drop FROM branch_falls WHERE avg_same_day > 0
),
worst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY branch_drop DESC, branch_id) AS rn
                 FROM branch_drops) WHERE rn = 1
),
section_falls AS (
  SELECT r.day, w.branch_id, p.section AS section_name,
         CAST(sum(CASE WHEN r.ref_day < r.day THEN net ELSE 0 END) AS DOUBLE) / max(r.n) AS section_avg_same_day,
         CAST(sum(CASE WHEN r.ref_day = r.day THEN net ELSE 0 END) AS DOUBLE) AS section_day_net
  FROM refs r JOIN worst w ON w.day = r.day
  JOIN sales s ON s.day = r.ref_day AND s.branch_id = w.branch_id
  JOIN products p ON p.product_id = s.product_id GROUP BY ALL
),
worst_sections AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY day ORDER BY section_drop DESC, section_name) AS rn
    FROM (SELECT *, (section_avg_same_day - section_day_net) / section_avg_same_day AS section_drop
          FROM section_falls WHERE section_avg_same_day > 0)) WHERE rn = 1
),
floors AS (
  SELECT branch_id, section AS section_name, avg(floor_qty) AS avg_floor
  FROM inventory JOIN products USING (product_id) GROUP BY ALL
),
discounts AS (
  SELECT r.day, w.branch_id, CAST(sum(coalesce(discount, 0)) AS DOUBLE) AS total_discount,
         CAST(sum(net) AS DOUBLE) AS total_sales
  FROM refs r JOIN worst w ON w.day = r.day
  JOIN sales s ON s.day = r.ref_day AND s.branch_id = w.branch_id GROUP BY ALL
),
heads AS (
  SELECT r.day, w.branch_id, r.ref_day, count(DISTINCT employee_id) AS staff
  FROM refs r JOIN worst w ON w.day = r.day
  JOIN sales s ON s.day = r.ref_day AND s.branch_id = w.branch_id GROUP BY ALL
),
crews AS (
  SELECT day, branch_id, coalesce(max(CASE WHEN ref_day = day THEN staff END), 0) AS day_staff,
         coalesce(avg(CASE WHEN ref_day < day THEN staff END), 0) AS avg_staff
  FROM heads GROUP BY ALL
)
"""

_SECTIONS = """
section_day AS (
  SELECT branch_id, branch_name, section AS section_name, day, CAST(sum(net) AS DOUBLE) AS section_revenue,
         count(DISTINCT employee_id) AS staff, count(DISTINCT transaction_id) AS traffic
  FROM sales JOIN products USING (product_id) GROUP BY ALL
),
branch_day AS (SELECT branch_id, day, sum(section_revenue) AS total FROM section_day GROUP BY ALL),
contrib AS (
  SELECT s.*, section_revenue / total * 100 AS contribution FROM section_day s JOIN branch_day USING (branch_id, day)
),
trend AS (
  SELECT c.branch_id, c.section_name, c.day, avg(h.contribution) AS m,
         coalesce(stddev_samp(h.contribution), 0) AS s, avg(h.staff) AS avg_staff, avg(h.traffic) AS avg_traffic
  FROM contrib c JOIN contrib h ON h.branch_id = c.branch_id AND h.section_name = c.section_name
   AND h.day BETWEEN c.day - 15 AND c.day - 1
  GROUP BY ALL
),
fallen AS (
  SELECT c.*, m, s, avg_staff, avg_traffic FROM contrib c JOIN trend USING (branch_id, section_name, day)
  WHERE c.section_name IN ('STANDARD', 'ECONOMY', 'MEDIUM') AND contribution < m - s
)
"""

_ENRICHED = """
enriched AS (
  SELECT s.*, product_name, category, section_id, section, cost, price,
         quantity * cost AS total_cost, net - quantity * cost AS gross_profit,
         CASE WHEN net <> 0 THEN CAST(net - quantity * cost AS DOUBLE) / CAST(net AS DOUBLE) * 100 END AS margin
  FROM sales s LEFT JOIN products USING (product_id)
)
"""

_STOCKOUT = """
sold AS (SELECT branch_id, product_id, CAST(sum(quantity) AS BIGINT) AS sold FROM sales GROUP BY ALL),
burn AS (
  SELECT i.branch_id, i.product_id, product_name, total_qty,
         CAST(sold AS DOUBLE) / greatest((SELECT count(DISTINCT day) FROM sales), 1) AS daily_burn
  FROM inventory i LEFT JOIN sold s ON s.branch_id = i.branch_id AND s.product_id = i.product_id
  JOIN products p ON p.product_id = i.product_id
),
risk AS (SELECT *, total_qty / nullif(daily_burn, 0) AS days_left FROM burn)
"""

_BASELINE = """
recent AS (
  SELECT * FROM sales JOIN products USING (product_id)
  WHERE ts >= (SELECT max(ts) - INTERVAL 90 DAY FROM sales)
),
base AS (
  SELECT CAST(sum(net) AS DOUBLE) AS total_revenue,
         CAST(sum(price) AS DOUBLE) / count(price) AS avg_price,
         CAST(sum(cost) AS DOUBLE) / count(cost) AS avg_cost,
         CAST(sum(price - cost) AS DOUBLE) / count(price - cost) AS avg_margin,
         count(DISTINCT transaction_id) AS total_transactions,
         CAST(sum(quantity) AS BIGINT) AS total_units,
         count(DISTINCT customer_id) AS total_customers
  FROM recent
)
"""


def _q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_SALES, *ctes]) + body


def _boosted() -> str:
    """A hundred rounds of least-squares trees of depth 3 over the months of each band."""
    sums = "(sums[{1} + 1] - sums[{0} + 1]) / ({1} - {0})"
    gap = f"({sums.format('p.a', 'c')} - {sums.format('c', 'p.b')})"
    cut = f"""list_max([{{'gain': (c - p.a) * (p.b - c) * {gap} * {gap}, 'cut': -c}} for c in range(p.a + 1, p.b)])"""
    levels = "SELECT *, [0, n] AS b0 FROM summed"
    for k in range(3):
        parts = f"[{{'a': b{k}[i], 'b': b{k}[i + 1]}} for i in range(1, len(b{k}))]"
        cuts = f"[-({cut}).cut for p in {parts} if p.b - p.a > 1]"
        levels = f"SELECT *, list_sort(b{k} || {cuts}) AS b{k + 1} FROM ({levels})"
    start, end = "list_max([b for b in b3 if b <= i - 1])", "list_min([b for b in b3 if b > i - 1])"
    return f""", monthly AS (
  SELECT age_segment AS segment, date_trunc('month', join_date) AS month, count(*) AS customers
  FROM banded WHERE join_date IS NOT NULL GROUP BY ALL),
series AS (
  SELECT segment, coalesce(sum(customers) FILTER (month(month) = 4), 0)::BIGINT AS actual, list(customers::DOUBLE ORDER BY month) AS y,
    count(*) AS n FROM monthly GROUP BY segment),
boosted AS (
  SELECT segment, 0 AS round, n, y, [list_sum(y) / n for v in y] AS f FROM series
  UNION ALL
  SELECT segment, round + 1, n, y,
    [f[i] + 0.1::DOUBLE * ({sums.format(f"({start})", f"({end})")}) for i in range(1, n + 1)]
  FROM (WITH summed AS (
      SELECT *, [coalesce(list_sum([y[j] - f[j] for j in range(1, i + 1)]), 0) for i in range(0, n + 1)] AS sums FROM boosted WHERE round < 100)
    {levels})),
forecasts AS (
  SELECT segment, CASE WHEN n >= 3 THEN f[n] ELSE list_sum(y) / n END AS fitted FROM boosted WHERE round = 100)"""


_RFM_COLUMNS = """SELECT customer_id, recency, frequency, monetary, recency_score, frequency_score,
       monetary_score, rfm_score, segment FROM rfm"""

_STOCKOUT_COLUMNS = """SELECT branch_id, product_id, product_name AS product_name_en, total_qty,
        round(daily_burn, 6) AS daily_burn, round(days_left, 6) AS days_left,
        CASE WHEN days_left < 7 THEN 'Critical' WHEN days_left < 14 THEN 'Warning' ELSE 'OK' END AS risk_level
        FROM risk"""

_VELOCITY = """, daily_qty AS (SELECT product_id, day, CAST(sum(quantity) AS DOUBLE) AS q FROM sales GROUP BY ALL),
        judged AS (
          SELECT d.product_id, d.day,
                 (SELECT avg(q) FROM daily_qty w WHERE w.product_id = d.product_id AND w.day BETWEEN d.day - 6 AND d.day) AS week_mean,
                 (SELECT avg(q) FROM daily_qty w WHERE w.product_id = d.product_id AND w.day BETWEEN d.day - 34 AND d.day - 7) AS base_mean,
                 (SELECT stddev_pop(q) FROM daily_qty w WHERE w.product_id = d.product_id AND w.day BETWEEN d.day - 34 AND d.day - 7) AS base_std
          FROM daily_qty d)"""

ORACLE: dict[str, str] = {
    "sales_enriched": _q(
        """SELECT product_id, branch_id, transaction_id, ts AS timestamp, employee_id, customer_id, quantity,
        CAST(gross AS DOUBLE) AS gross_amount, CAST(discount AS DOUBLE) AS discount_amount,
        CAST(net AS DOUBLE) AS net_amount, section_id, product_name AS product_name_en, category,
        CAST(cost AS DOUBLE) AS cost_jod, CAST(price AS DOUBLE) AS price_jod, section AS section_name, branch_name,
        day AS date, strftime(ts, '%b') AS month, CAST(month(ts) AS INTEGER) AS month_num,
        CAST(total_cost AS DOUBLE) AS total_cost, CAST(gross_profit AS DOUBLE) AS gross_profit,
        round(margin, 6) AS margin_pct FROM enriched""",
        _ENRICHED,
    ),
    "overview_kpis": _q(
        """SELECT CAST(sum(net) AS DOUBLE) AS total_revenue, round(avg(margin), 6) AS avg_margin_pct,
        count(DISTINCT transaction_id) AS transactions FROM enriched""",
        _ENRICHED,
    ),
    "branch_revenue": _q(
        "SELECT branch_name, CAST(sum(net) AS DOUBLE) AS net_amount FROM sales GROUP BY 1"
    ),
    "daily_sales_forecast": _q(
        """, fit AS (
          SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(day) AS last FROM (
            SELECT day, CAST(sum(net) AS DOUBLE) AS y, CAST(day - DATE '1995-01-01' AS DOUBLE) AS x
            FROM sales GROUP BY day))
        SELECT CAST(last + CAST(i AS INTEGER) AS DATE) AS date,
               round(a + b * (last + CAST(i AS INTEGER) - DATE '1995-01-01'), 2) AS predicted_sales
        FROM fit CROSS JOIN range(1, 8) t(i)"""
    ),
    "holiday_forecast": _q(
        """, wanted(event_order, event) AS (VALUES (1, 'Eid Al-Fitr Season'), (2, 'Eid Al-Adha Season'),
                                                   (3, 'Christmas Season')),
        fits AS (
          SELECT w.event, w.event_order, count(h.year) AS n, avg(net_amount) AS mean,
                 regr_slope(net_amount, h.year - 1995) AS b, regr_intercept(net_amount, h.year - 1995) AS a
          FROM wanted w LEFT JOIN holidays h ON h.event = w.event AND h.year < 2000 GROUP BY ALL)
        SELECT CAST(year AS INTEGER) AS year, event, round(net_amount, 2) AS net_amount, 'actual' AS kind,
               event_order FROM holidays JOIN wanted USING (event)
        UNION ALL
        SELECT 2000, event, round(CASE WHEN n = 0 THEN 550000 WHEN n = 1 THEN mean ELSE a + 5 * b END, 2),
               'forecast', event_order FROM fits""",
        _HOLIDAYS,
    ),
    "customer_base_projection": _q(
        """, yearly AS (SELECT year(join_date) AS join_year, count(*) AS new_customers FROM customers GROUP BY 1)
        SELECT CAST(y.join_year AS INTEGER) AS join_year, new_customers,
               (SELECT CAST(sum(new_customers) AS BIGINT) FROM yearly p WHERE p.join_year <= y.join_year) AS total_customers,
               2003 AS target_year,
               CAST(trunc((SELECT count(*) FROM customers) *
                          pow(1.15, 2003 - (SELECT max(join_year) FROM yearly))) AS BIGINT) AS projected_customers
        FROM yearly y"""
    ),
    "monthly_new_customers": _q(
        """SELECT age_segment AS segment, CAST(date_trunc('month', join_date) AS DATE) AS month, count(*) AS customers
        FROM banded WHERE join_date IS NOT NULL GROUP BY ALL"""
    ),
    "customer_growth_forecast": _q(
        _boosted() + """
        SELECT g.segment, coalesce(s.actual, 0) AS actual, round(f.fitted, 6) AS fitted,
          CASE WHEN coalesce(trunc(f.fitted), 0) < 10 THEN g.floor ELSE trunc(f.fitted)::BIGINT END AS forecast
        FROM (VALUES ('Adult (41-55)', 122), ('Middle (28-40)', 122), ('Young (19-27)', 91)) g(segment, floor)
        LEFT JOIN series s ON s.segment = g.segment LEFT JOIN forecasts f ON f.segment = g.segment"""
    ).replace("WITH", "WITH RECURSIVE", 1),
    "age_segment_quantity": _q(
        """SELECT age_segment, CAST(sum(quantity) AS BIGINT) AS quantity
        FROM sales JOIN banded USING (customer_id) GROUP BY 1"""
    ),
    "price_tier_revenue": _q(
        f""", tiers AS (
          SELECT {_TIER} AS price_tier, CAST(sum(quantity) AS BIGINT) AS quantity,
                 CAST(sum(quantity * price) AS DOUBLE) AS revenue
          FROM sales JOIN products USING (product_id) WHERE price IS NOT NULL GROUP BY 1)
        SELECT *, round(revenue / (SELECT sum(revenue) FROM tiers) * 100, 6) AS revenue_share_pct FROM tiers"""
    ),
    "season_volume": _q(
        f"""SELECT {_SEASON} AS season, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS transactions
        FROM sales GROUP BY 1"""
    ),
    "season_age_hotspots": _q(
        f"""SELECT {_SEASON} AS season, age_segment, CAST(sum(quantity) AS BIGINT) AS quantity,
        CAST(sum(net) AS DOUBLE) AS net_amount FROM sales JOIN banded USING (customer_id) GROUP BY 1, 2"""
    ),
    "age_price_affinity": _q(
        f"""SELECT {_TIER} AS price_tier,
        CAST(coalesce(sum(quantity) FILTER (band = 'Young'), 0) AS BIGINT) AS "Young",
        CAST(coalesce(sum(quantity) FILTER (band = 'Middle'), 0) AS BIGINT) AS "Middle",
        CAST(coalesce(sum(quantity) FILTER (band = 'Adult'), 0) AS BIGINT) AS "Adult"
        FROM sales JOIN banded USING (customer_id) JOIN products USING (product_id) GROUP BY 1"""
    ),
    "season_age_revenue": _q(
        f"""SELECT {_SEASON} AS season,
        CAST(coalesce(sum(net) FILTER (band = 'Young'), 0) AS DOUBLE) AS "Young",
        CAST(coalesce(sum(net) FILTER (band = 'Middle'), 0) AS DOUBLE) AS "Middle",
        CAST(coalesce(sum(net) FILTER (band = 'Adult'), 0) AS DOUBLE) AS "Adult"
        FROM sales JOIN banded USING (customer_id) GROUP BY 1"""
    ),
    "holiday_performance": _q(
        "SELECT CAST(year AS INTEGER) AS year, event, quantity, net_amount FROM holidays", _HOLIDAYS
    ),
    "stockout_days": _q(_STOCKOUT_COLUMNS, _STOCKOUT),
    "stockout_risk": _q(
        _STOCKOUT_COLUMNS + " WHERE days_left IS NOT NULL ORDER BY risk.days_left, branch_id, product_id LIMIT 12",
        _STOCKOUT,
    ),
    "replenishment_trigger": _q(
        _VELOCITY
        + """, alerts AS (SELECT product_id, day FROM judged WHERE week_mean > base_mean + 2 * base_std),
        marked AS (
          SELECT branch_id, product_id, days_left, coalesce(days_left < 7, false) AS runs_out,
                 EXISTS (SELECT 1 FROM alerts a WHERE a.product_id = risk.product_id
                         AND a.day = (SELECT max(day) FROM alerts)) AS sells_fast FROM risk)
        SELECT branch_id, product_id, round(days_left, 6) AS days_left, runs_out, sells_fast
        FROM marked WHERE runs_out OR sells_fast""",
        _STOCKOUT,
    ),
    "stockout_kpis": _q(
        """SELECT count(*) FILTER (days_left < 7) AS critical_items, count(*) FILTER (days_left < 14) AS warning_items,
        round(avg(days_left), 6) AS avg_days_left FROM risk""",
        _STOCKOUT,
    ),
    "rfm_scores": _q(_RFM_COLUMNS, _rfm("sales")),
    "rfm_scores_purchases": _q(_RFM_COLUMNS, _rfm("purchases")),
    "rfm_segment_summary": _q(
        """, names(segment) AS (VALUES ('Champions'), ('Loyal'), ('At-Risk'), ('Lost'))
        SELECT n.segment, count(customer_id) AS customer_count,
               round_even(count(customer_id) * 100.0::DOUBLE / (SELECT count(*) FROM rfm), 2) AS percentage
        FROM names n LEFT JOIN rfm USING (segment) GROUP BY 1""",
        _rfm("sales"),
    ),
    "rfm_segment_revenue": _q(
        """SELECT segment, CAST(sum(CAST(monetary AS DECIMAL(18,4))) AS DOUBLE) AS monetary FROM rfm GROUP BY 1""",
        _rfm("sales"),
    ),
    "churn_by_segment": _q(
        """SELECT CASE WHEN ms >= 4 THEN 'Champions' WHEN ms >= 3 THEN 'Loyal' WHEN ms >= 2 THEN 'At-Risk'
        ELSE 'Lost' END AS segment, round(avg(1 - exp(-0.05 * recency)), 6) AS churn_probability
        FROM parts GROUP BY 1""",
        _rfm("sales"),
    ),
    "rca_profit_trigger": _q(
        """SELECT day, net_amount, CAST(n AS INTEGER) AS history_days, round(m, 6) AS mean_net, round(s, 6) AS std_net,
        round(drop_pct, 6) AS drop_pct,
        coalesce(drop_pct > 0.35 OR net_amount < m - 2 * s, false) AS is_anomaly FROM trig""",
        _TRIGGER,
    ),
    "rca_worst_branch": _q(
        """SELECT f.day, CAST(f.n AS INTEGER) AS history_days, round(f.drop_pct, 6) AS total_drop, branch_id, branch_name,
        round(avg_same_day, 6) AS avg_same_day, day_net, round(branch_drop, 6) AS branch_drop
        FROM flagged f LEFT JOIN worst w ON w.day = f.day""",
        _TRIGGER,
    ),
    "rca_worst_section": _q(
        """SELECT f.day, w.branch_id, x.section_name, round(section_avg_same_day, 6) AS section_avg_same_day,
        section_day_net, round(section_drop, 6) AS section_drop
        FROM flagged f LEFT JOIN worst w ON w.day = f.day LEFT JOIN worst_sections x ON x.day = f.day""",
        _TRIGGER,
    ),
    "rca_floor_stock": _q(
        """SELECT f.day, w.branch_id, x.section_name, round(avg_floor, 6) AS avg_floor,
        coalesce(avg_floor, 99) < 4 AS stock_issue
        FROM flagged f LEFT JOIN worst w ON w.day = f.day LEFT JOIN worst_sections x ON x.day = f.day
        LEFT JOIN floors l ON l.branch_id = w.branch_id AND l.section_name = x.section_name""",
        _TRIGGER,
    ),
    "rca_discount_ratio": _q(
        """SELECT day, branch_id, total_discount, total_sales, round(total_discount / total_sales, 6) AS discount_ratio,
        total_discount / total_sales > 0.20 AS discount_issue FROM discounts""",
        _TRIGGER,
    ),
    "rca_staffing": _q(
        """SELECT day, branch_id, day_staff, round(avg_staff, 6) AS avg_staff,
        CASE WHEN day_staff < avg_staff THEN 'Understaffed' ELSE 'Adequate' END AS staffing_status FROM crews""",
        _TRIGGER,
    ),
    "rca_profit_diagnosis": _q(
        """, joined AS (
          SELECT f.day, w.branch_id, w.branch_name, x.section_name, f.drop_pct, section_drop, avg_floor,
                 coalesce(avg_floor, 99) < 4 AS stock_issue, total_discount / total_sales AS ratio,
                 CASE WHEN day_staff < avg_staff THEN 'Understaffed' ELSE 'Adequate' END AS staffing_status
          FROM flagged f LEFT JOIN worst w ON w.day = f.day LEFT JOIN worst_sections x ON x.day = f.day
          LEFT JOIN floors l ON l.branch_id = w.branch_id AND l.section_name = x.section_name
          LEFT JOIN discounts d ON d.day = f.day LEFT JOIN crews c ON c.day = f.day)
        SELECT day, branch_id, branch_name, section_name, round(drop_pct * 100, 6) AS total_drop_pct,
               round(section_drop * 100, 6) AS section_drop_pct, round(avg_floor, 6) AS avg_floor, stock_issue,
               round(ratio, 6) AS discount_ratio, ratio > 0.20 AS discount_issue, staffing_status,
               CASE WHEN stock_issue THEN 'Low Floor Stock Availability' WHEN ratio > 0.20 THEN 'High Discount Impact'
                    WHEN staffing_status = 'Understaffed' THEN 'Staffing Shortage'
                    ELSE 'Mixed Operational Factors' END AS primary_reason
        FROM joined""",
        _TRIGGER,
    ),
    "rca_section_contribution": _q(
        """SELECT branch_id, section_name, day, section_revenue, branch_name, round(contribution, 6) AS contribution
        FROM contrib""",
        _SECTIONS,
    ),
    "rca_section_anomalies": _q(
        """SELECT branch_id, branch_name, section_name, day, round(contribution, 6) AS contribution,
        round(m, 6) AS expected_contribution, round(s, 6) AS deviation FROM fallen""",
        _SECTIONS,
    ),
    "rca_section_diagnosis": _q(
        """, stock AS (
          SELECT branch_id, section AS section_name, avg(floor_qty) AS avg_floor
          FROM inventory JOIN products USING (product_id) GROUP BY ALL)
        SELECT branch_id, branch_name, section_name, day, round(contribution, 6) AS contribution,
          round(m, 6) AS expected_contribution,
          CASE WHEN coalesce(avg_floor, 99) < 4 THEN 'Low Stock on Floor' WHEN staff < avg_staff THEN 'Staffing Inadequacy'
               WHEN traffic < avg_traffic THEN 'Low Section Traffic' ELSE 'Product Mix/Assortment Failure' END AS bottleneck,
          CASE WHEN coalesce(avg_floor, 99) < 4
               THEN printf('Average Floor Quantity for %s is %.1f (Threshold: < 4).', section_name, round_even(avg_floor, 1))
               WHEN staff < avg_staff
               THEN printf('Active staff for %s was %d (15-day average: %.1f).', section_name, staff, round_even(avg_staff, 1))
               WHEN traffic < avg_traffic
               THEN printf('Section traffic was %d transactions (15-day average: %.1f).', traffic, round_even(avg_traffic, 1))
               ELSE 'Inventory, Staffing, and Traffic appear normal.' END AS details
        FROM fallen LEFT JOIN stock USING (branch_id, section_name)""",
        _SECTIONS,
    ),
    "baseline_metrics": _q(
        """SELECT total_revenue, round(avg_price, 6) AS avg_price, round(avg_cost, 6) AS avg_cost,
        round(avg_margin, 6) AS avg_margin, total_transactions, total_units, total_customers,
        round(avg_margin / avg_price, 6) AS margin_pct FROM base""",
        _BASELINE,
    ),
    "scenario_impact": _q(
        """, scenarios AS (
          SELECT p_partkey AS scenario_id, CAST(p_partkey % 41 AS DOUBLE) AS p, CAST(p_partkey * 7 % 61 AS DOUBLE) AS d,
                 CAST(p_partkey * 11 % 51 AS DOUBLE) AS i, CAST(p_partkey * 13 % 31 AS DOUBLE) AS w,
                 CAST(p_partkey * 17 % 101 AS DOUBLE) AS r FROM part),
        moved AS (
          SELECT *, avg_price * (1 + p / 100) * (1 - d / 100) AS net_price,
                 greatest(-0.80, least(0.80, (p * -1.5 + d * 1.8 + i * 0.3) / 100)) AS dv,
                 greatest(-0.80, least(1.00, (p * -0.5 + d * 0.7 + w * 0.25) / 100)) AS dc,
                 avg_cost * (1 - w * 0.0008) AS effective_cost
          FROM scenarios CROSS JOIN base),
        sized AS (
          SELECT *, CAST(trunc(total_units * (1 + dv)) AS BIGINT) AS units,
                 CAST(trunc(total_customers * (1 + dc)) AS BIGINT) AS customers,
                 net_price < effective_cost AS margin_alert FROM moved),
        priced AS (
          SELECT *, net_price * units * ((1 + w * 0.0008) * (1 + r * 0.0001)) AS revenue,
                 (net_price - effective_cost) * units - (avg_price - avg_cost) * total_units AS profit_delta,
                 p * 0.50 + d * 0.35 + (100 - r) * 0.15 + CASE WHEN margin_alert THEN 25 ELSE 0 END AS risk_score
          FROM sized)
        SELECT scenario_id, round(net_price, 2) AS net_price, units, customers, total_customers AS base_customers,
               round(revenue, 2) AS revenue, round(profit_delta, 2) AS profit_delta, margin_alert,
               CASE WHEN w > 15 THEN 'Optimized' WHEN w > 5 THEN 'Improving' ELSE 'Baseline' END AS efficiency,
               CASE WHEN d > 20 OR w > 15 THEN 'High Traffic' ELSE 'Normal' END AS traffic,
               round(risk_score, 2) AS risk_score,
               CASE WHEN risk_score > 40 THEN 'High' WHEN risk_score > 20 THEN 'Medium' ELSE 'Low' END AS risk,
               round((revenue - total_revenue) / total_revenue * 100, 2) AS revenue_change_pct
        FROM priced""",
        _BASELINE,
    ),
    "discount_sensitivity": _q(
        """, totals AS (SELECT CAST(sum(gross) AS DOUBLE) AS g, CAST(sum(discount) AS DOUBLE) AS d,
                              CAST(sum(net) AS DOUBLE) AS n FROM sales)
        SELECT CAST(rate AS INTEGER) AS rate, round(g * (1 - rate / 100), 2) AS simulated_net,
               round(g * (1 - rate / 100) - n, 2) AS delta, round(n, 2) AS actual_net,
               round(d / g * 100, 2) AS current_rate
        FROM totals CROSS JOIN range(0, 51) t(rate)"""
    ),
    "daily_target_attainment": _q(
        """, running AS (SELECT day, ts, sum(gross) OVER (PARTITION BY day ORDER BY ts) AS so_far FROM purchases),
        days AS (SELECT day, CAST(sum(gross) AS DOUBLE) AS gross_amount FROM purchases GROUP BY day)
        SELECT day, gross_amount, 600.0::DOUBLE AS target, gross_amount >= 600 AS reached,
               (SELECT min(ts) FROM running r WHERE r.day = days.day AND so_far >= 600) AS first_reached FROM days"""
    ),
    "trading_band_sales": _q(
        """SELECT day, CASE WHEN hour(ts) BETWEEN 20 AND 22 THEN 'peak' WHEN hour(ts) BETWEEN 11 AND 19 THEN 'off_peak'
        ELSE 'closed' END AS band, count(*) AS lines, CAST(sum(gross) AS DOUBLE) AS gross_amount,
        round(CAST(sum(gross) AS DOUBLE) / count(gross), 6) AS mean_price FROM purchases GROUP BY 1, 2"""
    ),
    "stream_daily_revenue": _q(
        """SELECT day, CAST(sum(gross) AS DOUBLE) AS gross_amount, 600.0::DOUBLE AS target, sum(gross) >= 600 AS reached
        FROM purchases GROUP BY day"""
    ),
    "stream_counted_revenue": _q(
        """SELECT day, CAST(sum(gross) AS DOUBLE) AS gross_amount, 600.0::DOUBLE AS target, sum(gross) >= 600 AS reached
        FROM purchases GROUP BY day"""
    ),
    "stream_first_reached": _q(
        """, running AS (SELECT day, ts, sum(gross) OVER (PARTITION BY day ORDER BY ts) AS so_far FROM purchases)
        SELECT day, CAST(sum(gross) AS DOUBLE) AS gross_amount, 600.0::DOUBLE AS target, sum(gross) >= 600 AS reached,
          (SELECT min(r.ts) FROM running r WHERE r.day = p.day AND r.so_far >= 600) AS first_reached
        FROM purchases p GROUP BY day
        HAVING CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM purchases)"""
    ),
    "hourly_staffing": _q(
        """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS lines, CAST(sum(net) AS DOUBLE) AS net_amount,
        count(DISTINCT employee_id) AS employees,
        round(CAST(sum(net) AS DOUBLE) / count(DISTINCT employee_id), 6) AS net_per_employee FROM purchases GROUP BY 1"""
    ),
    "velocity_alert": _q(
        _VELOCITY
        + """
        SELECT product_id, day, round(week_mean, 6) AS week_mean, round(base_mean, 6) AS base_mean,
               round(base_std, 6) AS base_std FROM judged WHERE week_mean > base_mean + 2 * base_std"""
    ),
    "replenishment_list": _q(
        """, out AS (SELECT branch_id, product_id, sum(quantity) AS sold FROM sales
                     WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM sales) GROUP BY ALL),
        now AS (SELECT i.branch_id, i.product_id,
                       CAST(greatest(floor_qty - coalesce(sold, 0), 0) AS BIGINT) AS floor_now,
                       greatest(total_qty - floor_qty, 0) AS backstock
                FROM inventory i LEFT JOIN out o ON o.branch_id = i.branch_id AND o.product_id = i.product_id)
        SELECT *, CAST(least(backstock, 8 - floor_now) AS BIGINT) AS refill FROM now WHERE floor_now < 4"""
    ),
    "replenishment_events": _q(
        """, day_sales AS (
          SELECT branch_id, product_id, day, sum(quantity) AS sold,
                 row_number() OVER (PARTITION BY branch_id, product_id ORDER BY day) AS step
          FROM sales WHERE ts > (SELECT max(ts) - INTERVAL 365 DAY FROM sales) GROUP BY branch_id, product_id, day),
        ledger AS (
          SELECT branch_id, product_id, 0::BIGINT AS step, NULL::DATE AS day, NULL::BIGINT AS floor_before, 0::BIGINT AS refill,
                 floor_qty::BIGINT AS floor, greatest(total_qty - floor_qty, 0)::BIGINT AS backstock FROM inventory
          UNION ALL
          SELECT branch_id, product_id, step, day, left_over, refill, left_over + refill, backstock - refill FROM (
            SELECT *, CASE WHEN left_over < 4 THEN least(backstock, 8 - left_over) ELSE 0 END AS refill FROM (
              SELECT l.branch_id, l.product_id, d.step, d.day, l.backstock, greatest(l.floor - d.sold, 0)::BIGINT AS left_over
              FROM ledger l JOIN day_sales d
                ON d.branch_id = l.branch_id AND d.product_id = l.product_id AND d.step = l.step + 1)))
        SELECT branch_id, product_id, day, floor_before, refill, backstock AS backstock_after FROM ledger
        WHERE step > 0 AND floor_before < 4"""
    ).replace("WITH", "WITH RECURSIVE", 1),
    "staff_reallocation": _q(
        """, by_date AS (
          SELECT branch_id, day, hour(ts) AS hour, count(DISTINCT employee_id) AS staff, sum(net) AS net
          FROM purchases GROUP BY ALL),
        sold AS (SELECT branch_id, isodow(day) - 1 AS weekday, hour, sum(staff) AS staff, sum(net) AS net FROM by_date GROUP BY ALL),
        hours AS (
          SELECT branch_id, weekday, hour, sum(staff)::BIGINT AS staff, sum(net) AS net FROM (
            SELECT * FROM sold
            UNION ALL SELECT DISTINCT branch_id, weekday, h.hour, 0, 0 FROM sold, (VALUES (16), (17), (18), (19)) h(hour))
          GROUP BY ALL),
        worth AS (
          SELECT *, CASE WHEN staff > 0 THEN greatest(trunc(net * 100)::BIGINT, 0) // staff ELSE 0 END AS worth,
            hour < 12 AS morning, hour BETWEEN 16 AND 19 AS rush FROM hours),
        totals AS (
          SELECT branch_id, weekday, sum(staff) FILTER (morning)::BIGINT * 25 // 100 AS moving, sum(worth) FILTER (rush)::BIGINT AS pulls
          FROM worth GROUP BY ALL),
        parts AS (
          SELECT w.*, coalesce(t.moving, 0) AS moving,
            coalesce((SELECT sum(x.staff)::BIGINT FROM worth x WHERE x.branch_id = w.branch_id AND x.weekday = w.weekday AND x.morning
                      AND (x.worth < w.worth OR x.worth = w.worth AND x.hour < w.hour)), 0) AS gone,
            CASE WHEN t.pulls > 0 THEN t.pulls ELSE 4 END AS pulls, CASE WHEN t.pulls > 0 THEN w.worth ELSE 1 END AS pull
          FROM worth w JOIN totals t ON t.branch_id = w.branch_id AND t.weekday = w.weekday),
        shares AS (
          SELECT *, CASE WHEN rush THEN moving * pull // pulls ELSE 0 END AS quota, CASE WHEN rush THEN moving * pull % pulls END AS remainder
          FROM parts),
        filled AS (
          SELECT *, sum(quota) OVER (PARTITION BY branch_id, weekday) AS given,
            row_number() OVER (PARTITION BY branch_id, weekday, rush ORDER BY remainder DESC, hour) AS place FROM shares),
        moves AS (
          SELECT *, quota + CASE WHEN rush AND place <= moving - given THEN 1 ELSE 0 END
            - CASE WHEN morning THEN greatest(least(staff, moving - gone), 0) ELSE 0 END AS moved FROM filled)
        SELECT branch_id, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, staff AS staff_hours,
          CAST(moved AS BIGINT) AS moved, CAST(staff + moved AS BIGINT) AS staff_hours_after,
          CASE WHEN staff > 0 THEN round(CAST(net AS DOUBLE) / staff, 6) END AS net_per_staff_hour FROM moves"""
    ),
    "price_string_clean": """
        WITH texts AS (
          SELECT p_partkey AS product_id, CASE p_partkey % 4 WHEN 0 THEN 'JOD ' || printf('%.2f', p_retailprice)
                   WHEN 1 THEN printf('%.2f', p_retailprice) || ' JOD'
                   WHEN 2 THEN 'JD 1,' || printf('%.2f', p_retailprice)
                   ELSE 'on request' END AS price_text FROM part)
        SELECT product_id, price_text, CAST(round(CASE p_partkey % 4 WHEN 2 THEN 1000 + price WHEN 3 THEN NULL ELSE price END, 2) AS DOUBLE) AS price
        FROM texts JOIN (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part) ON p_partkey = product_id""",
    "rolling_metrics": _q(
        """, per_day AS (SELECT day, sum(net) AS net, sum(gross_profit) AS profit,
                                count(DISTINCT transaction_id) AS transactions FROM enriched GROUP BY day)
        SELECT d.day, CAST(d.net AS DOUBLE) AS net, CAST(d.profit AS DOUBLE) AS profit, d.transactions,
          (SELECT CAST(sum(net) AS DOUBLE) FROM per_day w WHERE w.day BETWEEN d.day - 6 AND d.day) AS net_7d,
          (SELECT CAST(sum(profit) AS DOUBLE) FROM per_day w WHERE w.day BETWEEN d.day - 6 AND d.day) AS profit_7d,
          (SELECT count(DISTINCT transaction_id) FROM sales w WHERE w.day BETWEEN d.day - 6 AND d.day) AS transactions_7d,
          (SELECT CAST(sum(net) AS DOUBLE) FROM per_day w WHERE w.day BETWEEN d.day - 29 AND d.day) AS net_30d,
          (SELECT CAST(sum(profit) AS DOUBLE) FROM per_day w WHERE w.day BETWEEN d.day - 29 AND d.day) AS profit_30d,
          (SELECT count(DISTINCT transaction_id) FROM sales w WHERE w.day BETWEEN d.day - 29 AND d.day) AS transactions_30d
        FROM per_day d""",
        _ENRICHED,
    ),
    "low_stock_zero_sales": _q(
        """SELECT * FROM inventory i WHERE floor_qty < 4 AND NOT EXISTS (
          SELECT 1 FROM sales s WHERE s.branch_id = i.branch_id AND s.product_id = i.product_id
          AND ts >= (SELECT max(ts) - INTERVAL 30 DAY FROM sales))"""
    ),
    "low_margin_flag": _q(
        """SELECT transaction_id, product_id, branch_id, CAST(net AS DOUBLE) AS net_amount,
        CAST(gross_profit AS DOUBLE) AS gross_profit, round(margin, 6) AS margin_pct FROM enriched
        WHERE CAST(gross_profit AS DOUBLE) < abs(CAST(net AS DOUBLE)) * 0.05""",
        _ENRICHED,
    ),
    "anomaly_scope": _q(
        """, shares AS (SELECT day, count(*) AS branches,
                               count(*) FILTER (branch_drop > 0.35) / count(*) AS share FROM branch_drops GROUP BY day)
        SELECT day, branches, round(share, 6) AS fallen_share,
               CASE WHEN share >= 0.5 THEN 'systemic' ELSE 'localized' END AS scope FROM shares""",
        _TRIGGER,
    ),
}
