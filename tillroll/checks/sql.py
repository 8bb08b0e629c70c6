"""Each registered question as SQL over the same tables, written without the library."""

from __future__ import annotations

LINES = """
lines AS (
  SELECT DISTINCT o_orderkey AS invoice, l_partkey AS stock_code, trim(p_name) AS description,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INTEGER) AS quantity,
         CAST(o_orderdate AS DATE) AS invoice_date,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price, o_custkey AS customer_id, n_name AS country
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey),
sales AS (
  SELECT invoice, stock_code, replace(description, '"', '') AS description, quantity, invoice_date,
         price, customer_id, country, CAST(quantity * price AS DECIMAL(18,2)) AS sales
  FROM lines
  WHERE customer_id IS NOT NULL AND quantity > 0 AND invoice_date <= DATE '2001-07-31'
    AND (country IS NULL OR country NOT IN ('NATION_21', 'NATION_22', 'NATION_23', 'NATION_24')))"""

RECENT = LINES + """,
recent AS (SELECT * FROM sales
  WHERE invoice_date BETWEEN DATE '2001-07-31' - 90 AND DATE '2001-07-31')"""

FIRST = """,
first_day AS (SELECT customer_id, min(invoice_date) AS d FROM sales GROUP BY customer_id),
first_quarter AS (
  SELECT customer_id, d,
    CAST(CASE WHEN date_diff('day', d, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH AS DATE))
                <= date_diff('day', CAST(date_trunc('quarter', d) AS DATE), d)
         THEN date_trunc('quarter', d) + INTERVAL 3 MONTH
         ELSE date_trunc('quarter', d) END AS DATE) AS q
  FROM first_day),
home_of AS (
  SELECT customer_id, country FROM (
    SELECT s.customer_id, s.country,
           row_number() OVER (PARTITION BY s.customer_id ORDER BY s.invoice_date, s.country) AS k
    FROM sales s) WHERE k = 1),
purchases AS (
  SELECT f.customer_id, f.d AS first_purchase_date, f.q AS first_purchase_quarter,
         concat('Q', quarter(f.q), '-', year(f.q)) AS first_purchase_cohort, h.country
  FROM first_quarter f JOIN home_of h USING (customer_id))"""

BUCKET = "(CAST(concat('0x', substr(md5(CAST(customer_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"

FEATURES = f""",
cut AS (SELECT max(invoice_date) - 90 AS day FROM sales),
ref AS (SELECT max(invoice_date) AS day FROM sales, cut
        WHERE invoice_date <= cut.day AND {BUCKET} < 80),
before_cut AS (
  SELECT customer_id, CAST(date_diff('day', any_value(ref.day), max(invoice_date)) AS INTEGER) AS recency,
         count(*) AS frequency, sum(sales) AS sales_sum
  FROM sales, cut, ref WHERE invoice_date <= cut.day GROUP BY customer_id),
after_cut AS (
  SELECT customer_id, sum(sales) AS spend_90_total, 1 AS spend_90_flag
  FROM sales, cut WHERE invoice_date > cut.day GROUP BY customer_id),
features AS (
  SELECT customer_id, recency, frequency, CAST(sales_sum AS DOUBLE) AS sales_sum,
         CAST(sales_sum AS DOUBLE) / frequency AS sales_mean,
         CAST(coalesce(spend_90_total, 0) AS DOUBLE) AS spend_90_total,
         CAST(coalesce(spend_90_flag, 0) AS INTEGER) AS spend_90_flag,
         CASE WHEN {BUCKET} < 80 THEN 'train' ELSE 'test' END AS split
  FROM before_cut LEFT JOIN after_cut USING (customer_id))"""

RULED = f"""WITH {LINES}{FIRST}{FEATURES},
scored AS (
  SELECT customer_id, sales_mean * frequency / 4000 AS pred_total,
         1 / (1 + abs(recency) / 30.0::DOUBLE) AS pred_prob, spend_90_total, spend_90_flag,
         abs(recency) AS recency, frequency, sales_sum, sales_mean
  FROM features WHERE split = 'test'),
ruled AS (
  SELECT scored.*, spend_90_total - pred_total AS spend_actual_vs_pred, country, first_purchase_cohort
  FROM scored LEFT JOIN purchases USING (customer_id))"""


def _baskets(before: str, n: int) -> str:
    return f"""WITH {before},
items AS (SELECT DISTINCT customer_id, stock_code FROM recent),
sizes AS (SELECT customer_id, count(*) AS n FROM items GROUP BY customer_id),
shared AS (
  SELECT a.customer_id, b.customer_id AS neighbour_id, count(*) AS c
  FROM items a JOIN items b ON a.stock_code = b.stock_code AND a.customer_id <> b.customer_id
  GROUP BY 1, 2),
cosines AS (
  SELECT s.customer_id, s.neighbour_id, s.c / sqrt(CAST(x.n * y.n AS DOUBLE)) AS similarity,
         CAST(s.c * s.c AS DOUBLE) / CAST(x.n * y.n AS DOUBLE) AS closeness
  FROM shared s JOIN sizes x ON x.customer_id = s.customer_id
                JOIN sizes y ON y.customer_id = s.neighbour_id),
nearest AS (
  SELECT customer_id, neighbour_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY closeness DESC, neighbour_id) AS rank
    FROM cosines) WHERE rank <= {n})"""


BASKETS = _baskets(RECENT, 5)
# The same among test customers only.
SCORED = _baskets(
    LINES
    + FEATURES
    + """,
recent AS (SELECT * FROM sales
  WHERE invoice_date BETWEEN DATE '2001-07-31' - 90 AND DATE '2001-07-31'
    AND customer_id IN (SELECT customer_id FROM features WHERE split = 'test'))""",
    3,
)

OFFERS = """,
means AS (
  SELECT n.customer_id, r.stock_code, r.description, sum(r.quantity) / count(*) AS mean_quantity,
         CAST(sum(r.sales) AS DOUBLE) / count(*) AS mean_sales
  FROM nearest n JOIN recent r ON r.customer_id = n.neighbour_id
  GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id
                               ORDER BY mean_sales DESC, stock_code, description) AS rank FROM means),
opportunities AS (
  SELECT customer_id, stock_code, description, mean_quantity, mean_sales, CAST(rank AS INTEGER) AS rank
  FROM ranked WHERE rank <= 10),
new_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id
                               ORDER BY mean_sales DESC, stock_code, description) AS rank
  FROM means m WHERE NOT EXISTS (
    SELECT 1 FROM items i WHERE i.customer_id = m.customer_id AND i.stock_code = m.stock_code)),
recommendations AS (
  SELECT customer_id, stock_code, description, mean_quantity, mean_sales, CAST(rank AS INTEGER) AS rank
  FROM new_ranked WHERE rank <= 10)"""
OFFERED = BASKETS + OFFERS

DAILY = f"""WITH {LINES},
daily AS (
  SELECT CASE WHEN country IS NULL THEN NULL WHEN country = 'NATION_1' THEN 'NATION_1'
              ELSE 'All Others' END AS series,
         invoice_date, CAST(sum(quantity) AS BIGINT) AS total_quantity
  FROM sales GROUP BY 1, 2),
ends AS (SELECT series, min(invoice_date) AS lo, max(invoice_date) AS hi FROM daily GROUP BY series),
calendar AS (
  SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS invoice_date FROM ends),
padded AS (
  SELECT c.series, c.invoice_date, coalesce(d.total_quantity, 0) AS total_quantity
  FROM calendar c LEFT JOIN daily d ON c.series IS NOT DISTINCT FROM d.series AND c.invoice_date = d.invoice_date),
future AS (
  SELECT series, CAST(unnest(generate_series(hi + 1, hi + 90, INTERVAL 1 DAY)) AS DATE) AS invoice_date
  FROM ends),
longer AS (
  SELECT series, invoice_date, total_quantity FROM padded
  UNION ALL SELECT series, invoice_date, NULL FROM future)"""


def _features_sql() -> str:
    parts = ["series", "invoice_date", "round(y, 6) AS total_quantity"]
    day = "date_diff('day', DATE '1970-01-01', invoice_date)"
    for p in (7, 14, 21, 28):
        parts.append(f"round(sin({day} * (2 * pi() / {p})), 6) AS sin{p}_k1")
        parts.append(f"round(cos({day} * (2 * pi() / {p})), 6) AS cos{p}_k1")
    parts.append("round(lag90, 6) AS total_quantity_lag90")
    for p in (7, 14, 21, 28):
        parts.append(
            f"round(avg(lag90) OVER (PARTITION BY series ORDER BY invoice_date "
            f"ROWS BETWEEN {(p - 1) // 2} PRECEDING AND {p // 2} FOLLOWING), 6) "
            f"AS total_quantity_lag90_roll_{p}"
        )
    return f"""{DAILY},
logged AS (SELECT series, invoice_date, ln(1 + total_quantity) AS y FROM longer),
lagged AS (SELECT *, lag(y, 90) OVER (PARTITION BY series ORDER BY invoice_date) AS lag90 FROM logged)
SELECT {", ".join(parts)} FROM lagged"""


CLEANED = DAILY + """,
logged AS (SELECT series, invoice_date, ln(1 + total_quantity) AS y,
                  dayofweek(invoice_date) AS wd FROM padded),
trended AS (SELECT *, avg(y) OVER (PARTITION BY series ORDER BY invoice_date
                                   ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t FROM logged),
by_day AS (SELECT series, wd, avg(y - t) AS s FROM trended GROUP BY 1, 2),
season AS (SELECT series, wd, s - avg(s) OVER (PARTITION BY series) AS s FROM by_day),
rest AS (SELECT x.series, x.invoice_date, x.y, b.s, x.y - x.t - b.s AS r
         FROM trended x JOIN season b ON b.series = x.series AND b.wd = x.wd),
quartiles AS (SELECT series, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3
              FROM rest GROUP BY series),
marked AS (SELECT rest.*, NOT (r BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)) AS bad,
                  date_diff('day', DATE '1970-01-01', invoice_date) AS k
           FROM rest JOIN quartiles USING (series)),
sides AS (
  SELECT *,
    last_value(CASE WHEN NOT bad THEN k END IGNORE NULLS) OVER back AS k0,
    last_value(CASE WHEN NOT bad THEN y - s END IGNORE NULLS) OVER back AS x0,
    first_value(CASE WHEN NOT bad THEN k END IGNORE NULLS) OVER ahead AS k1,
    first_value(CASE WHEN NOT bad THEN y - s END IGNORE NULLS) OVER ahead AS x1
  FROM marked
  WINDOW back AS (PARTITION BY series ORDER BY invoice_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         ahead AS (PARTITION BY series ORDER BY invoice_date
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
cleaned AS (
  SELECT series, invoice_date, y, bad,
    CASE WHEN bad THEN coalesce(x0 + (x1 - x0) / (k1 - k0) * (k - k0) + s, x0 + s, x1 + s, y)
         ELSE y END AS c,
    invoice_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS in_window
  FROM sides)"""

NAIVE = DAILY + """,
naive AS (
  SELECT series, invoice_date, total_quantity,
         lag(total_quantity, 90) OVER (PARTITION BY series ORDER BY invoice_date) AS before
  FROM longer),
forecast AS (
  SELECT series, invoice_date,
         CASE WHEN total_quantity IS NULL THEN 'prediction' ELSE 'actual' END AS key,
         CASE WHEN total_quantity IS NULL THEN '60 Day Future Forecast'
              ELSE 'Trailing 6 Months' END AS period,
         CAST(coalesce(total_quantity, before) AS DOUBLE) AS value
  FROM naive WHERE invoice_date >= DATE '2000-09-01'),
placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY invoice_date DESC) AS k FROM forecast),
view_rows AS (SELECT * FROM placed WHERE k > 30 AND k <= 30 + 6 * 30 + 60)"""

NAIVE_MODELS = DAILY + """,
logged AS (SELECT series, invoice_date, ln(1 + total_quantity) AS y FROM longer),
lagged AS (SELECT *, lag(y, 90) OVER (PARTITION BY series ORDER BY invoice_date) AS l FROM logged),
rolled AS (
  SELECT *,
    avg(l) OVER (PARTITION BY series ORDER BY invoice_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m7,
    avg(l) OVER (PARTITION BY series ORDER BY invoice_date ROWS BETWEEN 13 PRECEDING AND 14 FOLLOWING) AS m28
  FROM lagged),
predicted AS (
  SELECT 1 AS model_id, 'LAG' AS model_desc, series, invoice_date, y, l AS p FROM rolled WHERE l IS NOT NULL
  UNION ALL
  SELECT 2, 'MEAN 7', series, invoice_date, y, m7 FROM rolled WHERE l IS NOT NULL
  UNION ALL
  SELECT 3, 'MEAN 28', series, invoice_date, y, m28 FROM rolled WHERE l IS NOT NULL),
with_mean AS (
  SELECT * FROM predicted
  UNION ALL
  SELECT 0, 'ENSEMBLE (MEAN): 4 MODELS', series, invoice_date, max(y), avg(p)
  FROM predicted GROUP BY series, invoice_date),
last_day AS (SELECT max(invoice_date) AS d FROM predicted WHERE y IS NOT NULL),
test AS (SELECT with_mean.* FROM with_mean, last_day WHERE y IS NOT NULL AND invoice_date > d - 90),
reach AS (SELECT model_id, quantile_cont(abs(y - p), 0.95) AS reach FROM test GROUP BY 1)"""

WEEK = "((dayofyear(invoice_date) - 1) // 7 + 1)"


def _text(value: str, digits: int, sign: str = "") -> str:
    return f"format('{{:,.{digits}f}}', {value})"


def _dollars(value: str, digits: int) -> str:
    return (
        f"concat(CASE WHEN round({value}, {digits}) < 0 THEN '-' ELSE '' END, '$', "
        f"{_text(f'abs({value})', digits)})"
    )


def _percent(value: str, digits: int) -> str:
    return f"concat({_text(f'({value}) * 100', digits)}, '%')"


MONEY = ("pred_total", "spend_90_total", "sales_sum", "sales_mean", "spend_actual_vs_pred")


def _money(digits: int) -> str:
    return ", ".join(f"{_dollars(c, digits)} AS {c}" for c in MONEY)


ACF_LAGS = 28


def _acf() -> str:
    sums = ", ".join(f"sum(x * x{k}) AS p{k}" for k in range(1, ACF_LAGS + 1))
    lags = ", ".join(
        f"lag(x, {k}) OVER (PARTITION BY series ORDER BY invoice_date) AS x{k}"
        for k in range(1, ACF_LAGS + 1)
    )
    rows = " UNION ALL ".join(
        f"SELECT series, {k} AS lag, p{k} / power AS acf FROM sums" for k in range(1, ACF_LAGS + 1)
    )
    return f"""{DAILY.replace("WITH", "WITH RECURSIVE", 1)},
centred AS (SELECT series, invoice_date,
              total_quantity - avg(total_quantity) OVER (PARTITION BY series) AS x FROM daily),
lagged AS (SELECT series, x, {lags} FROM centred),
sums AS (SELECT series, sum(x * x) AS power, {sums} FROM lagged GROUP BY series),
acf AS ({rows})"""


# Durbin-Levinson: phi holds the coefficients of order k.
PACF = """,
lists AS (SELECT series, list(acf ORDER BY lag) AS r FROM acf GROUP BY series),
steps AS (
  SELECT series, r, 1 AS k, [r[1]] AS phi, r[1] AS pacf FROM lists
  UNION ALL
  SELECT series, r, k + 1,
         list_append(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), last),
         last
  FROM (SELECT *,
          (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
          / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS last
        FROM steps WHERE k < 28))"""


def _bounds() -> str:
    digits = {"pred_total": 0, "pred_prob": 2, "spend_90_total": 0, "recency": 0, "frequency": 0}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS facet, CAST(round_even(min(CAST({c} AS DOUBLE)), {d}) AS DOUBLE) AS low, "
        f"CAST(round_even(max(CAST({c} AS DOUBLE)), {d}) AS DOUBLE) AS high FROM ruled"
        for c, d in digits.items()
    )


def _choices() -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS facet, CAST({c} AS VARCHAR) AS choice FROM ruled"
        for c in ("country", "first_purchase_cohort", "spend_90_flag")
    )


def _scaled() -> str:
    return " UNION ALL ".join(
        f"SELECT customer_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
        f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM features)) * 10 / "
        f"nullif((SELECT max({c}) FROM features) - (SELECT min({c}) FROM features), 0) AS value_scaled "
        "FROM features"
        for c in ("recency", "frequency", "sales_sum")
    )


def _slices() -> str:
    slices = ", ".join(f"({k + 1}, {90 * (k + 1)}, {90 * k})" for k in range(4))
    return f"""{DAILY},
ends_all AS (SELECT min(invoice_date) AS lo, max(invoice_date) AS hi FROM padded),
slices AS (SELECT id, hi - back AS train_end, hi - front AS assess_end
           FROM ends_all, (VALUES {slices}) v(id, back, front) WHERE hi - back >= lo)
SELECT series, invoice_date, total_quantity, id AS slice_id,
       CASE WHEN invoice_date <= train_end THEN 'train' ELSE 'test' END AS part
FROM padded JOIN slices ON invoice_date <= assess_end"""


TABLE = "customer_id, recency, frequency, sales_sum, sales_mean, spend_90_total, spend_90_flag"

ITEM_NEAREST = f"""WITH {RECENT},
items AS (SELECT DISTINCT customer_id, stock_code FROM recent),
sizes AS (SELECT stock_code, count(*) AS n FROM items GROUP BY stock_code),
shared AS (
  SELECT a.stock_code, b.stock_code AS similar_code, count(*) AS c
  FROM items a JOIN items b ON a.customer_id = b.customer_id AND a.stock_code <> b.stock_code
  GROUP BY 1, 2)
SELECT stock_code, similar_code, similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT s.stock_code, s.similar_code, s.c / sqrt(CAST(x.n * y.n AS DOUBLE)) AS similarity,
         row_number() OVER (PARTITION BY s.stock_code
           ORDER BY CAST(s.c * s.c AS DOUBLE) / CAST(x.n * y.n AS DOUBLE) DESC, s.similar_code) AS rank
  FROM shared s JOIN sizes x ON x.stock_code = s.stock_code
                JOIN sizes y ON y.stock_code = s.similar_code)
WHERE rank <= 5"""

LABEL = f"""SELECT customer_id, concat_ws(chr(10),
  concat('Customer ID: ', customer_id), concat('90-Day Spend Prob: ', {_percent("pred_prob", 1)}),
  concat('90-Day Spend Pred: ', {_dollars("pred_total", 2)}),
  concat('Actual 90-Day Spend: ', {_dollars("spend_90_total", 2)}),
  concat('Actual vs Pred: ', {_dollars("spend_actual_vs_pred", 2)}), '---',
  concat('Recency: ', recency), concat('Frequency: ', frequency)) AS text FROM ruled"""

COLOR = """CASE
  WHEN spend_actual_vs_pred BETWEEN -500 AND -250 THEN 'color0'
  WHEN spend_actual_vs_pred BETWEEN -249 AND 0 THEN 'color1'
  WHEN spend_actual_vs_pred BETWEEN 0 AND 250 THEN 'color2'
  WHEN spend_actual_vs_pred BETWEEN 251 AND 500 THEN 'color3'
  WHEN spend_actual_vs_pred BETWEEN 501 AND 1000 THEN 'color4'
  WHEN spend_actual_vs_pred BETWEEN 1001 AND 1250 THEN 'color5'
  WHEN spend_actual_vs_pred BETWEEN 1251 AND 1500 THEN 'color6'
  ELSE 'color7' END AS color"""

ROC = """,
by_score AS (SELECT pred_prob AS score, sum(spend_90_flag) AS pos, sum(1 - spend_90_flag) AS neg
             FROM ruled GROUP BY 1),
placed AS (
  SELECT score, pos, neg,
         coalesce(sum(pos) OVER below, 0) AS pos_below, coalesce(sum(neg) OVER below, 0) AS neg_below,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM by_score
  WINDOW below AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

HOME = "series = 'NATION_1'"
SIDES = f""",
sides AS (
  SELECT invoice_date, period,
    coalesce(sum(CASE WHEN {HOME} THEN CASE WHEN value < 5 THEN 0 ELSE value END END), 0) AS h,
    coalesce(sum(CASE WHEN NOT coalesce({HOME}, FALSE) THEN CASE WHEN value < 5 THEN 0 ELSE value END END), 0) AS o
  FROM view_rows GROUP BY 1, 2)"""

ORACLE: dict[str, str] = {
    "clean_sales": f"""WITH {LINES}
SELECT invoice, stock_code, description, quantity, invoice_date, CAST(price AS DOUBLE) AS price,
       customer_id, country, CAST(sales AS DOUBLE) AS sales FROM sales""",
    "date_range": f"""WITH {LINES}
SELECT min(invoice_date) AS first_day, max(invoice_date) AS last_day FROM sales""",
    "first_purchase": f"WITH {LINES}{FIRST} SELECT * FROM purchases",
    "first_purchase_per_country": f"""WITH {LINES}{FIRST}
SELECT p.customer_id, first_purchase_date, first_purchase_quarter, first_purchase_cohort, c.country
FROM purchases p JOIN (SELECT DISTINCT customer_id, country FROM sales) c USING (customer_id)""",
    "cohort_sizes": f"""WITH {LINES}{FIRST}
SELECT first_purchase_cohort, count(DISTINCT customer_id) AS n FROM purchases GROUP BY 1""",
    "analysis_cohort": f"""WITH {RECENT}{FIRST}
SELECT r.customer_id, r.invoice, r.stock_code, r.description, r.quantity, r.invoice_date,
       CAST(r.price AS DOUBLE) AS price, r.country, CAST(r.sales AS DOUBLE) AS sales,
       p.first_purchase_cohort
FROM recent r JOIN purchases p USING (customer_id)
WHERE p.first_purchase_cohort IN ('Q2-1995') AND r.country IN ('NATION_1')""",
    "analysis_cohort_all": f"""WITH {RECENT}{FIRST}
SELECT r.customer_id, r.invoice, r.stock_code, r.description, r.quantity, r.invoice_date,
       CAST(r.price AS DOUBLE) AS price, r.country, CAST(r.sales AS DOUBLE) AS sales,
       p.first_purchase_cohort
FROM recent r JOIN purchases p USING (customer_id)""",
    "customer_split": f"""WITH {LINES}
SELECT customer_id, CASE WHEN {BUCKET} < 80 THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT customer_id FROM sales)""",
    "rfm_features": f"""WITH {LINES}{FEATURES}
SELECT customer_id, split, recency, frequency, sales_sum, sales_mean FROM features""",
    "clv_training_table": f"WITH {LINES}{FEATURES} SELECT {TABLE} FROM features WHERE split = 'train'",
    "clv_testing_table": f"WITH {LINES}{FEATURES} SELECT {TABLE} FROM features WHERE split = 'test'",
    "clv_testing_history": f"""WITH {LINES}{FEATURES}
SELECT customer_id, CAST(date_diff('day', any_value(ref.day), max(invoice_date)) AS INTEGER) AS recency,
       count(*) AS frequency, CAST(sum(sales) AS DOUBLE) AS sales_sum,
       CAST(sum(sales) AS DOUBLE) / count(*) AS sales_mean
FROM sales, ref WHERE {BUCKET} >= 80 GROUP BY customer_id""",
    "rule_facets": f"""{RULED} SELECT * FROM ruled
WHERE country IN ({", ".join(f"'NATION_{k}'" for k in range(12))})
  AND pred_total BETWEEN 25 AND 225 AND pred_prob BETWEEN 0.05::DOUBLE AND 0.9::DOUBLE
  AND spend_90_total BETWEEN 0 AND 60000 AND spend_90_flag IN (0, 1)
  AND recency BETWEEN 0 AND 400 AND frequency BETWEEN 1 AND 60""",
    "rule_facet_bounds": f"{RULED} {_bounds()}",
    "rule_facet_choices": f"{RULED} {_choices()}",
    "rule_customer_choices": f"""{RULED}
SELECT DISTINCT country, customer_id FROM ruled WHERE spend_90_flag = 1""",
    "rule_country_choices": f"""{RULED}
SELECT DISTINCT country, customer_id FROM ruled
WHERE spend_90_flag = 1 AND country IN ('NATION_1', 'NATION_2')""",
    "rule_chart_rows": f"{RULED} SELECT * FROM ruled WHERE spend_actual_vs_pred BETWEEN -100 AND 1500",
    "rule_table": f"""{RULED}
SELECT customer_id, {_percent("pred_prob", 1)} AS pred_prob, spend_90_flag, recency, frequency,
       {_money(1)}, country, first_purchase_cohort FROM ruled""",
    "rule_bucket_table": f"""{RULED}
SELECT customer_id, {_percent("pred_prob", 2)} AS pred_prob, spend_90_flag, recency, frequency,
       {_money(2)}, country, first_purchase_cohort, {COLOR}
FROM ruled WHERE spend_actual_vs_pred BETWEEN -500 AND 2500""",
    "rule_labels": f"{RULED} {LABEL}",
    "rule_segment_likely": f"{RULED} SELECT * FROM ruled ORDER BY pred_prob DESC, customer_id",
    "rule_segment_unlikely": f"""{RULED}
SELECT * FROM ruled WHERE recency < 90 AND pred_prob < 0.6::DOUBLE ORDER BY pred_prob DESC, customer_id""",
    "rule_segment_missed": f"""{RULED}
SELECT * FROM ruled WHERE spend_90_total = 0 ORDER BY pred_total DESC, customer_id""",
    "rule_metrics": f"""{RULED}{ROC}
SELECT round((SELECT avg(abs(spend_90_total - pred_total)) FROM ruled), 6) AS mae,
       round(sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (max(p) * max(n)), 6) AS roc_auc FROM placed""",
    "rule_roc_curve": f"""{RULED}{ROC}
SELECT score AS threshold, CAST(neg_below AS DOUBLE) / n AS specificity,
       CAST(p - pos_below AS DOUBLE) / p AS sensitivity FROM placed
UNION ALL SELECT CAST('-inf' AS DOUBLE), 0.0::DOUBLE, 1.0::DOUBLE
UNION ALL SELECT CAST('inf' AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""",
    "scaled_features": f"WITH {LINES}{FEATURES} {_scaled()}",
    "customer_sample": f"""WITH {LINES}{FEATURES}
SELECT customer_id, recency, frequency, sales_sum, sales_mean FROM features WHERE {BUCKET} < 10""",
    "user_items": f"WITH {RECENT} SELECT DISTINCT customer_id, stock_code FROM recent",
    "user_similarity": f"""{BASKETS}{FIRST},
picked AS (SELECT min(customer_id) AS customer_id
           FROM sizes JOIN purchases USING (customer_id) GROUP BY country)
SELECT customer_id, neighbour_id, similarity FROM cosines JOIN picked USING (customer_id)""",
    "nearest_customers": f"{BASKETS} SELECT * FROM nearest",
    "nearest_items": ITEM_NEAREST,
    "opportunities": f"{OFFERED} SELECT * FROM opportunities",
    "recommendations": f"{OFFERED} SELECT * FROM recommendations",
    "scored_recommendations": f"{SCORED}{OFFERS} SELECT * FROM recommendations",
    "recommendation_text": f"""{OFFERED}
SELECT customer_id, string_agg(description, ', ' ORDER BY rank) AS products
FROM recommendations GROUP BY customer_id""",
    "opportunity_table": f"""{OFFERED}
SELECT customer_id, stock_code, description, {_text("mean_quantity", 0)} AS mean_quantity,
       {_dollars("mean_sales", 1)} AS mean_sales, rank FROM opportunities""",
    "sales_by_country": f"""WITH {LINES},
totals AS (SELECT country, CAST(sum(quantity) AS BIGINT) AS q, sum(sales) AS s FROM sales GROUP BY country)
SELECT country, q AS total_quantity, CAST(s AS DOUBLE) AS total_sales,
       q / CAST(sum(q) OVER () AS DOUBLE) AS pct_total_qty,
       CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) AS pct_total_sales
FROM totals ORDER BY s DESC""",
    "daily_quantity": f"{DAILY} SELECT * FROM daily",
    "weekday_profile": f"""{DAILY}
SELECT series, strftime(invoice_date, '%a') AS wday, CAST(sum(total_quantity) AS BIGINT) AS total_quantity
FROM daily GROUP BY 1, 2""",
    "padded_series": f"{DAILY} SELECT * FROM padded",
    "future_frame": f"{DAILY} SELECT * FROM future",
    "numbered_series": f"""{DAILY}
SELECT series, invoice_date, total_quantity,
       row_number() OVER (ORDER BY series NULLS FIRST, invoice_date) AS row_id FROM longer""",
    "ts_features": _features_sql(),
    "calendar_signature": f"""{DAILY}
SELECT series, invoice_date, total_quantity,
  date_diff('day', DATE '1970-01-01', invoice_date) * 86400 AS index_num,
  CAST(year(invoice_date) AS INTEGER) AS "year",
  CASE WHEN quarter(invoice_date) <= 2 THEN 1 ELSE 2 END AS half,
  CAST(quarter(invoice_date) AS INTEGER) AS "quarter", CAST(month(invoice_date) AS INTEGER) AS "month",
  strftime(invoice_date, '%B') AS month_lbl, CAST(day(invoice_date) AS INTEGER) AS "day",
  0 AS "minute", 0 AS "second", 1 AS am_pm, CAST(dayofweek(invoice_date) + 1 AS INTEGER) AS wday,
  strftime(invoice_date, '%A') AS wday_lbl, CAST(day(invoice_date) AS INTEGER) AS mday,
  CAST(date_diff('day', CAST(date_trunc('quarter', invoice_date) AS DATE), invoice_date) + 1 AS INTEGER) AS qday,
  CAST(dayofyear(invoice_date) AS INTEGER) AS yday,
  CAST((day(invoice_date) + dayofweek(CAST(date_trunc('month', invoice_date) AS DATE)) + 6) // 7 AS INTEGER)
    AS mweek,
  CAST({WEEK} AS INTEGER) AS "week", CAST({WEEK} % 2 AS INTEGER) AS week2,
  CAST({WEEK} % 3 AS INTEGER) AS week3, CAST({WEEK} % 4 AS INTEGER) AS week4,
  CAST(day(invoice_date) // 7 + 1 AS INTEGER) AS mday7
FROM padded""",
    "autocorrelation": f"{_acf()} SELECT series, lag, round(acf, 6) AS acf FROM acf",
    "partial_autocorrelation": f"""{_acf()}{PACF}
SELECT series, k AS lag, round(r[k], 6) AS acf, round(pacf, 6) AS pacf FROM steps""",
    "cv_plan": _slices(),
    "cv_folds": f"""{DAILY}
SELECT series, invoice_date,
  CAST(CAST(concat('0x', substr(md5(concat_ws('|', '123', series, CAST(invoice_date AS VARCHAR))), 1, 8))
       AS BIGINT) % 5 AS INTEGER) AS fold
FROM padded""",
    "cleaned_series": f"""{CLEANED}
SELECT series, invoice_date, round(y, 6) AS total_quantity, bad AS is_outlier,
       round(c, 6) AS total_quantity_cleaned, in_window FROM cleaned""",
    "repaired_series": f"""{CLEANED}
SELECT series, invoice_date, round(CASE WHEN in_window THEN c ELSE y END, 6) AS total_quantity
FROM cleaned""",
    "peak_repaired_series": f"""{CLEANED},
ranked AS (
  SELECT series, invoice_date AS peak, row_number() OVER (
    PARTITION BY series, date_trunc('quarter', invoice_date) ORDER BY y DESC, invoice_date) AS place
  FROM cleaned WHERE y IS NOT NULL)
SELECT series, invoice_date, round(CASE WHEN EXISTS (
    SELECT 1 FROM ranked WHERE place = 1 AND ranked.series = cleaned.series
    AND cleaned.invoice_date BETWEEN peak - 3 AND peak + 3) THEN c ELSE y END, 6) AS total_quantity
FROM cleaned""",
    "naive_accuracy": f"""{NAIVE},
pairs AS (
  SELECT series, invoice_date, CAST(total_quantity AS DOUBLE) AS a, CAST(before AS DOUBLE) AS p
  FROM naive WHERE total_quantity IS NOT NULL AND before IS NOT NULL),
stepped AS (SELECT *, abs(a - lag(a) OVER (PARTITION BY series ORDER BY invoice_date)) AS step FROM pairs)
SELECT series, round(avg(abs(a - p)), 6) AS mae,
  round(avg(CASE WHEN a <> 0 THEN abs(a - p) / abs(a) END) * 100, 6) AS mape,
  round(avg(abs(a - p)) / avg(step), 6) AS mase,
  round(avg(CASE WHEN abs(a) + abs(p) <> 0 THEN abs(a - p) / ((abs(a) + abs(p)) / 2) END) * 100, 6) AS smape,
  round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(corr(a, p) ** 2, 6) AS rsq
FROM stepped GROUP BY series""",
    "naive_model_accuracy": f"""{NAIVE_MODELS},
scaled AS (
  SELECT series, model_id, model_desc, invoice_date, exp(y) - 1 AS a, exp(p) - 1 AS p FROM test),
stepped AS (
  SELECT *, abs(a - lag(a) OVER (PARTITION BY series, model_id ORDER BY invoice_date)) AS step FROM scaled)
SELECT series, model_id, model_desc, round(avg(abs(a - p)), 6) AS mae,
  round(avg(abs(a - p)) / avg(step), 6) AS mase, round(sqrt(avg((a - p) ** 2)), 6) AS rmse,
  round(corr(a, p) ** 2, 6) AS rsq
FROM stepped GROUP BY 1, 2, 3""",
    "naive_resample_accuracy": f"""{NAIVE_MODELS},
known AS (SELECT * FROM predicted WHERE y IS NOT NULL),
slices AS (
  SELECT id, hi - back AS train_end, hi - front AS assess_end
  FROM (SELECT min(invoice_date) AS lo, max(invoice_date) AS hi FROM known),
       (VALUES (1, 90, 0), (2, 180, 90), (3, 270, 180), (4, 360, 270)) v(id, back, front)
  WHERE hi - back >= lo),
per_slice AS (
  SELECT model_id, model_desc, id, sqrt(avg((y - p) ** 2)) AS rmse
  FROM known JOIN slices ON invoice_date > train_end AND invoice_date <= assess_end GROUP BY 1, 2, 3)
SELECT model_id, model_desc, count(*) AS n, round(avg(rmse), 6) AS rmse_mean,
       round(stddev_samp(rmse), 6) AS rmse_sd
FROM per_slice GROUP BY 1, 2""",
    "naive_forecast_rows": f"""{NAIVE_MODELS}
SELECT series, CAST(NULL AS INTEGER) AS model_id, 'ACTUAL' AS model_desc, 'actual' AS key, invoice_date,
       round(exp(y) - 1, 6) AS value, CAST(NULL AS DOUBLE) AS conf_lo, CAST(NULL AS DOUBLE) AS conf_hi
FROM rolled WHERE y IS NOT NULL AND l IS NOT NULL
UNION ALL
SELECT series, model_id, model_desc, 'prediction', invoice_date, round(exp(p) - 1, 6),
       round(exp(p - reach) - 1, 6), round(exp(p + reach) - 1, 6)
FROM with_mean JOIN reach USING (model_id) WHERE y IS NULL""",
    "naive_forecast_view": f"""{NAIVE}
SELECT series, invoice_date, key, period, value, concat_ws(chr(10),
  concat('Date: ', invoice_date), concat('Country: ', series), concat('Key: ', period),
  concat('Quantity Sold: ', {_text("value", 0)})) AS text FROM view_rows""",
    "naive_forecast_table": f"""{NAIVE}{SIDES}
SELECT invoice_date, period, {_text("h + o", 0)} AS total_forecast, {_text("h", 0)} AS home_forecast,
  {_text("o", 0)} AS others_forecast,
  {_percent("CASE WHEN h + o = 0 THEN 0 ELSE h / (h + o) END", 1)} AS home_forecast_pct,
  {_percent("CASE WHEN h + o = 0 THEN 0 ELSE o / (h + o) END", 1)} AS others_forecast_pct
FROM sides""",
}
