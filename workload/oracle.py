"""SQL that states, for DuckDB, what each query must return."""

from __future__ import annotations

from workload.queries import CHOSEN_SEGMENT, EPS, EPS_SIX, K, LINK_HEIGHT, METRIC_CENTRES, MIN_SAMPLES, RANGE, RULES
from workload.queries import SCORE_CENTRES, WEIGHTS
from workload.tables import SNAPSHOT

TX = """tx AS (
  SELECT o_custkey AS customer_id, o_orderdate AS transaction_date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount
  FROM orders)"""

EVENTS = """tx AS (
  SELECT user_id AS customer_id, ts AS transaction_date, CAST(round(value * 100) AS BIGINT) AS amount
  FROM events)"""

SEGMENTS = """seg AS (
  SELECT c_custkey AS customer_id, c_nationkey AS "cluster", c_mktsegment AS "Segment_label"
  FROM customer)"""

SEGMENTS_IN_CREDIT = SEGMENTS.replace("FROM customer", "FROM customer WHERE c_acctbal >= 0")

MESSY = """messy AS (
  SELECT o_orderkey,
    CASE o_orderkey % 11 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN ' ' || chr(9) || ' '
      WHEN 4 THEN chr(160) WHEN 5 THEN ' ' || CAST(o_custkey AS VARCHAR)
      ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
    CASE o_orderkey % 7 WHEN 1 THEN o_orderdate + INTERVAL '10 hours 30 minutes'
      WHEN 3 THEN NULL WHEN 4 THEN NULL
      WHEN 5 THEN o_orderdate + INTERVAL '23 hours 59 minutes 59.25 seconds'
      ELSE o_orderdate END AS transaction_date,
    CASE o_orderkey % 13 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
      WHEN 4 THEN CAST(0 AS DOUBLE) WHEN 5 THEN -o_totalprice WHEN 7 THEN NULL
      WHEN 8 THEN CAST(1000 AS DOUBLE) WHEN 9 THEN NULL ELSE o_totalprice END AS amount
  FROM orders)"""


def rfm_cte(snapshot: str) -> str:
    return f"""rfm AS (
  SELECT customer_id,
    CAST(floor((epoch_us(TIMESTAMP '{snapshot}') - epoch_us(max(transaction_date)))
               / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS recency,
    count(transaction_date) AS frequency,
    CAST(sum(amount) AS DOUBLE) AS monetary
  FROM tx WHERE amount > 0 GROUP BY customer_id)"""


RFM = f"{TX}, {rfm_cte(SNAPSHOT)}"

RANKS = f"""{RFM}, ranks AS (
  SELECT customer_id,
    row_number() OVER (ORDER BY recency, customer_id) AS recency_rank,
    row_number() OVER (ORDER BY frequency, customer_id) AS frequency_rank,
    row_number() OVER (ORDER BY monetary, customer_id) AS monetary_rank,
    count(*) OVER () AS n
  FROM rfm)"""


def _bin(metric: str) -> str:
    return (
        f"CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, (({metric}_rank - 1) * 5 + n - 2) // (n - 1))"
        " END AS INTEGER)"
    )


SCORES = f"""{RANKS}, scored AS (
  SELECT rfm.*, 6 - {_bin("recency")} AS "R_score", {_bin("frequency")} AS "F_score",
    {_bin("monetary")} AS "M_score"
  FROM rfm JOIN ranks USING (customer_id))"""


def _double(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def weighted_cte(weights) -> str:
    r, f, m = (f'"{x}_score" * {_double(getattr(weights, x))}' for x in "RFM")
    return f"""weighted AS (
  SELECT *, {r} AS "R_weighted", {f} AS "F_weighted", {m} AS "M_weighted",
    {f} + {m} AS "FM_weighted", {r} + {f} + {m} AS "RFM_weighted_sum"
  FROM scored)"""


def label_case(weights, rules) -> str:
    top_r, top_fm = 5.0 * weights.R, 5.0 * weights.F + 5.0 * weights.M

    def r(op: str, share: float) -> str:
        return f'"R_weighted" {op} {_double(share * top_r)}'

    def fm(op: str, share: float) -> str:
        return f'"FM_weighted" {op} {_double(share * top_fm)}'

    return f"""CASE
    WHEN {r(">=", rules.vip_r_min)} AND {fm(">=", rules.vip_fm_min)} THEN 'VIP / Champions'
    WHEN {r(">=", rules.loyal_r_min)} AND {fm(">=", rules.loyal_fm_min)} THEN 'Loyal / Active'
    WHEN {r(">=", rules.potential_r_min)} AND {fm(">=", rules.potential_fm_min)}
      THEN 'Potential Loyalists'
    WHEN {r("<=", rules.risk_r_max)} AND {fm(">=", rules.risk_fm_min)} THEN 'At Risk'
    WHEN {r("<=", rules.lost_r_max)} AND {fm("<=", rules.lost_fm_max)} THEN 'Lost'
    WHEN {r(">=", rules.new_r_min)} AND {fm("<=", rules.new_fm_max)} THEN 'New'
    ELSE 'Regular' END"""


RFM_SCORE = """CAST("R_score" AS VARCHAR) || CAST("F_score" AS VARCHAR)
    || CAST("M_score" AS VARCHAR)"""


def label_sql(weights, rules, columns: str) -> str:
    return f"""WITH {SCORES}, {weighted_cte(weights)}, labelled AS (
  SELECT *, {RFM_SCORE} AS "RFM_score",
    CAST("R_score" + "F_score" + "M_score" AS INTEGER) AS "RFM_sum",
    {label_case(weights, rules)} AS "Segment_label" FROM weighted)
SELECT {columns} FROM labelled"""


def _trend(source: str, bucket: str, label: str, step: str) -> str:
    return f"""WITH {source}, seen AS (
  SELECT {bucket} AS p, CAST(sum(amount) AS DOUBLE) AS revenue, count(amount) AS transactions,
    count(DISTINCT customer_id) AS active_customers
  FROM tx GROUP BY 1), every AS (
  SELECT unnest(generate_series((SELECT min(p) FROM seen), (SELECT max(p) FROM seen),
    INTERVAL {step})) AS p)
SELECT CAST({label} AS TIMESTAMP) AS transaction_date,
  coalesce(revenue, CAST(0 AS DOUBLE)) AS revenue, coalesce(transactions, 0) AS transactions,
  coalesce(active_customers, 0) AS active_customers,
  revenue / transactions AS avg_order_value
FROM every LEFT JOIN seen USING (p)"""


# Round half to even at two decimals, as on doubles.
def _even(value: str) -> str:
    return f"round_even(({value}) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)"


def growth_cte(segment: str, fill: bool) -> str:
    level = (
        "last_value(revenue IGNORE NULLS) OVER (PARTITION BY segment ORDER BY month"
        " ROWS UNBOUNDED PRECEDING)"
        if fill
        else "revenue"
    )
    return f"""{TX}, {SEGMENTS}, sums AS (
  SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, "{segment}" AS segment,
    CAST(sum(amount) AS DOUBLE) AS revenue
  FROM tx JOIN seg USING (customer_id) GROUP BY 1, 2), matrix AS (
  SELECT m.month, CAST(year(m.month) * 12 + month(m.month) - 1 AS INTEGER) AS month_index,
    s.segment, sums.revenue
  FROM (SELECT DISTINCT month FROM sums) m CROSS JOIN (SELECT DISTINCT segment FROM sums) s
  LEFT JOIN sums ON sums.month = m.month AND sums.segment = s.segment), levels AS (
  SELECT *, {level} AS cur FROM matrix), steps AS (
  SELECT *, lag(cur) OVER (PARTITION BY segment ORDER BY month) AS prev FROM levels), growth AS (
  SELECT *, CASE WHEN prev = 0 AND cur > 0 THEN CAST('inf' AS DOUBLE)
    WHEN prev = 0 AND cur < 0 THEN CAST('-inf' AS DOUBLE) WHEN prev = 0 THEN NULL
    ELSE cur / prev - 1 END AS change FROM steps)"""


GROWTH = growth_cte("Segment_label", True)

STEP = "strftime({m} - INTERVAL 1 MONTH, '%Y-%m') || ' → ' || strftime({m}, '%Y-%m')"

EVENT_ROWS = f"""{GROWTH}, best AS (
  SELECT * FROM growth WHERE change IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY change DESC, month) = 1), worst AS (
  SELECT * FROM growth WHERE change IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY change, month) = 1), events_found AS (
  SELECT best.segment, {_even("best.change * CAST(100 AS DOUBLE)")} AS best_growth_pct,
    {STEP.format(m="best.month")} AS best_step,
    {_even("worst.change * CAST(100 AS DOUBLE)")} AS worst_growth_pct,
    {STEP.format(m="worst.month")} AS worst_step
  FROM best JOIN worst USING (segment))"""

MEAN_GROWTH = f"""{GROWTH}, rates AS (
  SELECT segment, round(avg(change), 9) AS mean_growth FROM growth GROUP BY segment)"""

SEGMENT_TOTALS = """totals AS (
  SELECT "{seg}" AS segment, count(DISTINCT customer_id) AS customers, count(amount) AS transactions,
    CAST(sum(amount) AS DOUBLE) AS revenue
  FROM tx JOIN seg USING (customer_id) WHERE "{seg}" IS NOT NULL GROUP BY 1)"""


def _kpi(source: str, where: str = "TRUE") -> str:
    return f"""WITH {source}
SELECT count(DISTINCT customer_id) AS customers, count(*) AS rows,
  CAST(sum(amount) AS DOUBLE) AS revenue,
  CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_order
FROM tx WHERE {where}"""


IN_RANGE = f"transaction_date >= TIMESTAMP '{RANGE[0]}' AND transaction_date <= TIMESTAMP '{RANGE[1]}'"
IN_FULL_RANGE = (
    f"transaction_date >= TIMESTAMP '{RANGE[0]}'"
    f" AND transaction_date < TIMESTAMP '{RANGE[1]}' + INTERVAL 1 DAY"
)


def _standard(metric: str, weight: float = 1.0) -> str:
    x = f"{metric} * {_double(weight)}"
    return f"(({x}) - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0)"


SIX = ["recency", "frequency", "monetary", '"R_score"', '"F_score"', '"M_score"']
SCALED_SIX = f"""{SCORES}, scaled AS (
  SELECT customer_id, {", ".join(f"{_standard(m)} AS x{i}" for i, m in enumerate(SIX))} FROM scored)"""

SCALED = f"""{RFM}, scaled AS (
  SELECT customer_id, {_standard("recency")} AS x0, {_standard("frequency")} AS x1,
    {_standard("monetary")} AS x2 FROM rfm)"""


def _nearest(xs: list[str], centres) -> str:
    def distance(centre) -> str:
        return " + ".join(f"({x} - {_double(c)}) * ({x} - {_double(c)})" for x, c in zip(xs, centre))

    every = f"[{', '.join(distance(c) for c in centres)}]"
    return f"CAST(list_position({every}, list_min({every})) - 1 AS INTEGER)"


def _silhouette(points: str, distance: str, metric: str) -> str:
    """All pairs, spelled out."""
    return f"""WITH {points}, sizes AS (SELECT c, count(*) AS n FROM points GROUP BY c), means AS (
  SELECT a.id, a.c AS own, b.c AS other, sum({distance}) AS total
  FROM points a CROSS JOIN points b GROUP BY 1, 2, 3), sided AS (
  SELECT id, max(n) FILTER (WHERE own = other) AS n_own,
    max(total / nullif(n - 1, 0)) FILTER (WHERE own = other) AS inside,
    min(total / n) FILTER (WHERE own <> other) AS outside
  FROM means JOIN sizes ON sizes.c = means.other GROUP BY id)
SELECT '{metric}' AS metric, round(avg(CASE WHEN n_own = 1 OR greatest(inside, outside) = 0
  THEN CAST(0 AS DOUBLE) ELSE (outside - inside) / greatest(inside, outside) END), 9) AS silhouette
FROM sided"""


def dbscan_sql(scaled: str, d: int, eps: float, least: int = MIN_SAMPLES) -> str:
    gap = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(d))
    return f"""WITH RECURSIVE {scaled}, near AS MATERIALIZED (
  SELECT a.customer_id AS a, b.customer_id AS b FROM scaled a JOIN scaled b
  ON {gap} <= {_double(eps * eps)}), core AS MATERIALIZED (
  SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {least}), links AS MATERIALIZED (
  SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reached(root, id) AS (
  SELECT id, id FROM core
  UNION
  SELECT reached.root, links.b FROM reached JOIN links ON links.a = reached.id
  WHERE links.b > reached.root), firsts AS (
  SELECT id, min(root) AS root FROM reached GROUP BY id), roots AS (
  SELECT id, root FROM firsts), numbered AS (
  SELECT root, row_number() OVER (ORDER BY root) - 1 AS "cluster"
  FROM (SELECT DISTINCT root FROM roots)), labelled AS (
  SELECT id, "cluster" FROM roots JOIN numbered USING (root)), border AS (
  SELECT near.a AS id, min(labelled."cluster") AS "cluster"
  FROM near JOIN labelled ON labelled.id = near.b GROUP BY near.a)
SELECT scaled.customer_id,
  CAST(coalesce(labelled."cluster", border."cluster", -1) AS INTEGER) AS "cluster"
FROM scaled LEFT JOIN labelled ON labelled.id = scaled.customer_id
LEFT JOIN border ON border.id = scaled.customer_id"""


# K-Means in rounds, on points g0, g1, .. (multiples of 1e-9) that stand for w rows each.
GRID = "CAST(1e9 AS DOUBLE)"


def _list(template: str, d: int, glue: str = ", ") -> str:
    return glue.join(template.replace("#", str(i)) for i in range(d))


def _squared(a: str, b: str, d: int) -> str:
    return _list(f"({a}# - {b}#) * ({a}# - {b}#)", d, " + ")


def _means(alias: str, d: int) -> str:
    return _list(f"CAST(sum(g# * w) AS DOUBLE) / sum(w) / {GRID} AS {alias}#", d)


def kmeans_cte(name: str, points: str, k: int, d: int) -> str:
    """`name`_x: the points with x0..; `name`: (idx, c0..) of the centres that no round moves."""
    order = _list("x#", d)
    return f"""{name}_x AS MATERIALIZED (SELECT *, {_list(f"g# / {GRID} AS x#", d)} FROM {points}),
{name}_mean AS (SELECT {_means("m", d)} FROM {points}),
{name}_first AS (SELECT {_list("x# AS c#", d)} FROM {name}_x, {name}_mean
  ORDER BY {_squared("x", "m", d)} DESC, {order} LIMIT 1),
{name}_far AS (
  SELECT 1 AS step, {order}, {_list("c#", d)}, {_squared("x", "c", d)} AS far
  FROM {name}_x, {name}_first
  UNION ALL
  SELECT f.step + 1, {_list("f.x#", d)}, {_list("n.c#", d)}, least(f.far, {_squared("f.x", "n.c", d)})
  FROM {name}_far f,
    (SELECT {_list("x# AS c#", d)} FROM {name}_far ORDER BY far DESC, {order} LIMIT 1) n
  WHERE f.step < {k}),
{name}_rounds AS (
  SELECT DISTINCT 0 AS round, step - 1 AS idx, {_list("c#", d)}, FALSE AS done FROM {name}_far
  UNION ALL
  SELECT round + 1, idx, {_list("coalesce(n#, c#)", d)},
    bool_and({_list("coalesce(n#, c#) = c#", d, " AND ")}) OVER ()
  FROM {name}_rounds LEFT JOIN (
    SELECT own, {_means("n", d)} FROM (
      SELECT {_list("g#", d)}, w, min(struct_pack(far := {_squared("x", "c", d)}, i := idx)).i AS own
      FROM {name}_x, {name}_rounds GROUP BY {_list("g#", d)}, w)
    GROUP BY own) ON own = idx
  WHERE NOT done),
{name} AS (SELECT row_number() OVER (ORDER BY {_list("c#", d)}) - 1 AS idx, {_list("c#", d)}
  FROM {name}_rounds WHERE done)"""


def nearest_cte(name: str, fitted: str, d: int) -> str:
    """(g0.., x0.., w, own): the points of a fit and the centre nearest to each."""
    return f"""{name} AS MATERIALIZED (
  SELECT {_list("g#, x#", d)}, w, min(struct_pack(far := {_squared("x", "c", d)}, i := idx)).i AS own,
    min({_squared("x", "c", d)}) AS error
  FROM {fitted}_x, {fitted} GROUP BY {_list("g#, x#", d)}, w)"""


def grid_cte(name: str, columns: list[str], source: str) -> str:
    """`name`_rows: a row per customer with g0..; `name`: different points with their rows."""
    d = len(columns)
    grid = ", ".join(
        f"CAST(round_even(({c}) * {GRID}, 0) AS BIGINT) AS g{i}" for i, c in enumerate(columns)
    )
    return f"""{name}_rows AS MATERIALIZED (SELECT *, {grid} FROM {source}),
{name} AS MATERIALIZED (SELECT {_list("g#", d)}, count(*) AS w FROM {name}_rows GROUP BY ALL)"""


def tree_cte(name: str, points: str, k: int, d: int) -> str:
    """`name`: (g0.., leaf): the widest leaf is split in two until there are k."""
    key, parts = _list("g#", d), [f"{name}0 AS (SELECT {_list('g#', d)}, w, 0 AS leaf FROM {points})"]
    for s in range(1, k):
        before, here, cut = f"{name}{s - 1}", f"{name}{s}", f"{name}_cut{s}"
        parts.append(f"""{cut}_means AS (
  SELECT leaf, {_means("c", d)} FROM {before} GROUP BY leaf),
{cut}_errors AS (
  SELECT leaf, {_list("any_value(c#) AS c#", d)}, sum(w * ({_list(f"(g# / {GRID} - c#) * (g# / {GRID} - c#)", d, " + ")})) AS error
  FROM {before} JOIN {cut}_means USING (leaf) GROUP BY leaf),
{cut}_widest AS (SELECT leaf FROM {cut}_errors WHERE error > 0
  ORDER BY error DESC, {_list("c#", d)} LIMIT 1),
{cut}_points AS MATERIALIZED (SELECT {key}, w FROM {before} JOIN {cut}_widest USING (leaf)),
{kmeans_cte(cut, f"{cut}_points", 2, d)},
{nearest_cte(f"{cut}_own", cut, d)},
{here} AS MATERIALIZED (
  SELECT {_list("b.g#", d)}, b.w, coalesce({2 * s - 1} + o.own, b.leaf) AS leaf
  FROM {before} b LEFT JOIN {cut}_own o USING ({key}))""")
    last = f"{name}{k - 1}"
    parts.append(f"""{name}_means AS (SELECT leaf, {_means("c", d)} FROM {last} GROUP BY leaf),
{name}_order AS (
  SELECT leaf, row_number() OVER (ORDER BY {_list("c#", d)}) - 1 AS number FROM {name}_means),
{name} AS (SELECT {key}, number FROM {last} JOIN {name}_order USING (leaf))""")
    return ",\n".join(parts)


METRIC_GRID = grid_cte("pts", [_standard(m) for m in ("recency", "frequency", "monetary")], "rfm")
SCORE_GRID = grid_cte(
    "pts",
    [
        f"""coalesce(CAST("{x}_score" - min("{x}_score") OVER () AS DOUBLE)
      / nullif(max("{x}_score") OVER () - min("{x}_score") OVER (), 0), 0)"""
        for x in "RFM"
    ],
    "scored",
)


def sweep_sql(base: str, ks: range, distance: str, metric: str, tail: str) -> str:
    """K-Means and its silhouette, over all pairs of different points, for every k."""
    parts, rows = [base], []
    for k in ks:
        parts += [kmeans_cte(f"k{k}", "pts", k, 3), nearest_cte(f"own{k}", f"k{k}", 3)]
        parts.append(f"""sizes{k} AS (SELECT own, sum(w) AS n FROM own{k} GROUP BY own),
pairs{k} AS (
  SELECT a.g0, a.g1, a.g2, any_value(a.w) AS w, a.own, b.own AS other, sum(b.w * {distance}) AS total
  FROM own{k} a CROSS JOIN own{k} b GROUP BY a.g0, a.g1, a.g2, a.own, b.own),
sided{k} AS (
  SELECT any_value(w) AS w, max(n) FILTER (WHERE p.own = other) AS n_own,
    max(total / nullif(n - 1, 0)) FILTER (WHERE p.own = other) AS inside,
    min(total / n) FILTER (WHERE p.own <> other) AS outside
  FROM pairs{k} p JOIN sizes{k} s ON s.own = p.other GROUP BY g0, g1, g2)""")
        rows.append(f"""SELECT CAST({k} AS INTEGER) AS k,
  (SELECT round(sum(w * error), 6) FROM own{k}) AS inertia,
  round(sum(w * CASE WHEN n_own = 1 OR greatest(inside, outside) = 0 THEN CAST(0 AS DOUBLE)
    ELSE (outside - inside) / greatest(inside, outside) END) / sum(w), 9) AS silhouette,
  '{metric}' AS metric FROM sided{k}""")
    return f"WITH RECURSIVE {', '.join(parts)}, sweep AS ({' UNION ALL '.join(rows)}) {tail}"


SQUARED_GAP = _squared("a.x", "b.x", 3)
KS = range(2, 11)

ORACLE = {
    "csv_scan": """SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
  o_orderdate AS transaction_date, o_totalprice AS amount FROM orders""",
    "csv_scan_quoted": """SELECT 'order "' || l_orderkey || '";' || chr(10) || 'line, ' || l_linenumber
    || CASE WHEN l_linenumber % 2 = 0 THEN chr(13) || chr(10) || chr(10) ELSE '' END AS customer_id,
  CAST(l_shipdate AS TIMESTAMP) AS transaction_date, CAST(round(l_quantity * l_extendedprice * 100) AS BIGINT) AS amount
FROM lineitem""",
    "detect_separator": """SELECT written, TRUE AS found, CAST(6 AS INTEGER) AS fields,
  (SELECT count(*) FROM customer) AS lines
FROM (VALUES ('comma'), ('semicolon'), ('tab'), ('pipe')) AS v(written)""",
    "map_columns": """SELECT o_custkey AS customer_id, o_orderdate AS transaction_date,
  o_totalprice AS amount FROM orders""",
    "amount_qty_price": """SELECT o_custkey AS customer_id, o_orderdate AS transaction_date,
  CAST(round(l_quantity * l_extendedprice * 100) AS BIGINT) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "parquet_scan": "SELECT * FROM customer",
    "csv_export": """SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS transaction_date,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS amount FROM orders""",
    "export_manifest": """SELECT 'transactions' AS "table", count(*) AS "rows" FROM orders
UNION ALL SELECT 'rfm', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 0""",
    "dataset_profile": """SELECT 'orders' AS id, 'orders.parquet' AS original_name,
  count(*) AS "rows", count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS min_date,
  max(o_orderdate) AS max_date, 'o_custkey' AS customer_col
FROM orders WHERE o_totalprice > 0""",
    "coerce": f"WITH {MESSY} SELECT o_orderkey, transaction_date, amount FROM messy",
    "clean": f"""WITH {MESSY} SELECT o_orderkey, customer_id, transaction_date, amount FROM messy
WHERE transaction_date IS NOT NULL AND amount > 0
  AND trim(replace(replace(customer_id, chr(9), ' '), chr(160), ' ')) <> ''""",
    "clean_light": f"""WITH {MESSY}
SELECT o_orderkey, customer_id, transaction_date, amount FROM messy
WHERE customer_id IS NOT NULL AND transaction_date IS NOT NULL AND amount IS NOT NULL""",
    "date_range": f"""WITH {EVENTS} SELECT customer_id, transaction_date,
  amount FROM tx WHERE {IN_RANGE}""",
    "date_format_vote": """SELECT written, format, (SELECT count(*) FROM orders) AS known, (SELECT count(*) FROM orders) AS readable,
  (SELECT CAST(min(o_orderdate) AS TIMESTAMP) FROM orders) AS min_date, (SELECT CAST(max(o_orderdate) AS TIMESTAMP) FROM orders) AS max_date
FROM (VALUES ('day_first', 'd/M/yyyy[ H:mm[:ss]]'), ('month_first', 'M/d/yyyy[ H:mm[:ss]]'),
  ('dotted', 'd.M.yyyy[ H:mm[:ss]]'), ('iso', 'iso')) AS v(written, format)""",
    "date_range_stored": f"""WITH {EVENTS} SELECT customer_id, transaction_date,
  amount FROM tx WHERE {IN_RANGE}""",
    "date_range_full_day": f"""WITH {EVENTS} SELECT customer_id, transaction_date,
  amount FROM tx WHERE {IN_FULL_RANGE}""",
    "segments_placeholder": f"""WITH {EVENTS} SELECT customer_id, transaction_date,
  amount, '—' AS "cluster", '—' AS "Segment_label" FROM tx""",
    "attach_segments": f"""WITH {TX}, {SEGMENTS_IN_CREDIT} SELECT customer_id, transaction_date,
  amount, "cluster", "Segment_label"
FROM tx LEFT JOIN seg USING (customer_id)""",
    "dedup_segments": """SELECT o_custkey AS customer_id,
  CAST(substr(min(o_orderpriority), 1, 1) AS INTEGER) AS "cluster",
  min(o_orderpriority) AS "Segment_label" FROM orders GROUP BY o_custkey""",
    "segments_distinct": """SELECT DISTINCT c_mktsegment AS "Segment_label" FROM customer""",
    "segment_customers": f"""WITH {SEGMENTS}
SELECT * FROM seg WHERE "Segment_label" = '{CHOSEN_SEGMENT}'""",
    "recommendations": f"""WITH {SEGMENTS}, texts AS (
  SELECT c_mktsegment AS "Segment_label", 'Write to ' || max(c_name) AS recommendation
  FROM customer GROUP BY 1)
SELECT customer_id, "Segment_label", recommendation FROM seg LEFT JOIN texts USING ("Segment_label")""",
    "rfm": f"WITH {RFM} SELECT * FROM rfm",
    "rfm_incremental": f"WITH {RFM} SELECT * FROM rfm",
    "rfm_events": f"WITH {EVENTS}, {rfm_cte('2024-01-30 12:00:00')} SELECT * FROM rfm",
    "kpi": _kpi(TX),
    "kpi_range": _kpi(EVENTS, IN_RANGE),
    "trend_day": _trend(TX, "date_trunc('day', transaction_date)", "p", "1 DAY"),
    "trend_week": _trend(
        EVENTS, "date_trunc('week', transaction_date)", "p + INTERVAL 6 DAYS", "7 DAYS"
    ),
    "trend_month": _trend(TX, "date_trunc('month', transaction_date)", "last_day(p)", "1 MONTH"),
    "trend_month_sketch": "SELECT *, TRUE AS close FROM ("
    + _trend(TX, "date_trunc('month', transaction_date)", "last_day(p)", "1 MONTH") + ")",
    "kpi_sketch": " UNION ALL ".join(
        f"SELECT '{end}' AS until, TRUE AS close, * FROM ("
        + _kpi(TX, f"transaction_date >= TIMESTAMP '1995-01-10' AND transaction_date < TIMESTAMP '{end}' + INTERVAL 1 DAY") + ")"
        for end in ("1995-02-01", "1996-06-30", "2001-12-31")
    ),
    "segment_trend": f"""WITH {TX}, {SEGMENTS}
SELECT CAST(date_trunc('week', transaction_date) + INTERVAL 6 DAYS AS TIMESTAMP)
    AS transaction_date, "Segment_label", CAST(sum(amount) AS DOUBLE) AS revenue
FROM tx JOIN seg USING (customer_id) GROUP BY 1, 2""",
    "segment_share": f"""WITH {TX}, {SEGMENTS}, {SEGMENT_TOTALS.format(seg="Segment_label")}
SELECT segment, customers, revenue, revenue / transactions AS avg_order,
  {_even("revenue / (SELECT sum(revenue) FROM totals) * CAST(100 AS DOUBLE)")} AS share_pct
FROM totals""",
    "segment_comparison": f"""WITH {TX}, {SEGMENTS}, {SEGMENT_TOTALS.format(seg="cluster")}
SELECT *, revenue / transactions AS avg_order FROM totals""",
    "segment_comparison_order": f"""WITH {TX}, {SEGMENTS}, {SEGMENT_TOTALS.format(seg="cluster")}
SELECT segment, row_number() OVER (ORDER BY revenue DESC, segment) AS place FROM totals""",
    "report_summary": f"""WITH {EVENTS} SELECT count(*) AS rows,
  count(DISTINCT customer_id) AS customers, CAST(sum(amount) AS DOUBLE) AS revenue,
  CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_order,
  count(*) > 0 AS rfm_available, FALSE AS clusters_available FROM tx""",
    "report_insights": f"""WITH {TX}, k AS (SELECT count(*) AS n,
  count(DISTINCT customer_id) AS c, CAST(sum(amount) AS DOUBLE) AS revenue FROM tx)
SELECT round_even(n / c * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE) AS orders_per_customer,
  revenue / c > revenue / n * 2 AS vip_potential FROM k""",
    "month_segment_matrix": f"""WITH {GROWTH}
SELECT strftime(month, '%Y-%m') AS month, month_index, segment, revenue FROM matrix""",
    "month_segment_wide": f"""WITH {GROWTH} SELECT strftime(month, '%Y-%m') AS month,
  max(revenue) FILTER (WHERE segment = 'AUTOMOBILE') AS "AUTOMOBILE",
  max(revenue) FILTER (WHERE segment = 'BUILDING') AS "BUILDING",
  max(revenue) FILTER (WHERE segment = 'FURNITURE') AS "FURNITURE",
  max(revenue) FILTER (WHERE segment = 'HOUSEHOLD') AS "HOUSEHOLD",
  max(revenue) FILTER (WHERE segment = 'MACHINERY') AS "MACHINERY"
FROM matrix GROUP BY 1""",
    "segment_growth": f"""WITH {GROWTH} SELECT strftime(month, '%Y-%m') AS month, month_index,
  segment, revenue, round(change, 9) AS change FROM growth""",
    "segment_growth_nofill": f"""WITH {growth_cte("cluster", False)}
SELECT strftime(month, '%Y-%m') AS month, month_index, segment, revenue,
  round(change, 9) AS change FROM growth""",
    "growth_rate": f"WITH {MEAN_GROWTH} SELECT * FROM rates",
    "growth_events": f"WITH {EVENT_ROWS} SELECT * FROM events_found",
    "growth_extremes": f"""WITH {EVENT_ROWS}
SELECT * FROM (SELECT 'best' AS kind, segment, best_growth_pct AS change_pct, best_step AS step
  FROM events_found ORDER BY change_pct DESC, segment LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'worst' AS kind, segment, worst_growth_pct AS change_pct,
  worst_step AS step FROM events_found ORDER BY change_pct, segment LIMIT 1)""",
    "growth_direction": f"""WITH {MEAN_GROWTH} SELECT *, CASE WHEN mean_growth > 0 THEN 'growing'
  WHEN mean_growth < 0 THEN 'declining' WHEN mean_growth = 0 THEN 'flat' END AS direction
FROM rates""",
    "rfm_ranks": f"""WITH {RANKS}
SELECT customer_id, recency_rank, frequency_rank, monetary_rank FROM ranks""",
    "rfm_scores": f"""WITH {SCORES} SELECT *, {RFM_SCORE} AS "RFM_score",
  CAST("R_score" + "F_score" + "M_score" AS INTEGER) AS "RFM_sum" FROM scored""",
    "rfm_weighted": f"""WITH {SCORES}, {weighted_cte(WEIGHTS)}
SELECT customer_id, "R_weighted", "F_weighted", "M_weighted", "FM_weighted",
  "RFM_weighted_sum" FROM weighted""",
    "rfm_segments": label_sql(
        WEIGHTS, type(RULES)(), 'customer_id, "RFM_score", "RFM_sum", "Segment_label"'
    ),
    "rfm_segments_rules": label_sql(
        type(WEIGHTS)(), RULES, 'customer_id, "RFM_score", "Segment_label"'
    ),
    "label_counts": label_sql(
        type(WEIGHTS)(), type(RULES)(), '"Segment_label", count(*) AS customers'
    )
    + ' GROUP BY "Segment_label"',
    "features_standard": f"""WITH {RFM} SELECT customer_id,
  round({_standard("recency", WEIGHTS.R)}, 9) AS recency,
  round({_standard("frequency", WEIGHTS.F)}, 9) AS frequency,
  round({_standard("monetary", WEIGHTS.M)}, 9) AS monetary FROM rfm""",
    "features_minmax": f"""WITH {RFM} SELECT customer_id,
  round(CAST(recency - min(recency) OVER () AS DOUBLE)
    / (max(recency) OVER () - min(recency) OVER ()), 9) AS recency,
  CAST(0 AS DOUBLE) AS frequency,
  round((monetary - min(monetary) OVER ())
    / (max(monetary) OVER () - min(monetary) OVER ()), 9) AS monetary FROM rfm""",
    "kmeans_assign": f"""WITH {SCALED}
SELECT customer_id, {_nearest(["x0", "x1", "x2"], METRIC_CENTRES)} AS "cluster" FROM scaled""",
    "kmeans_segments": f"""WITH RECURSIVE {RFM}, {METRIC_GRID}, {kmeans_cte("km", "pts", K, 3)},
{nearest_cte("owned", "km", 3)}
SELECT customer_id, recency, frequency, monetary, CAST(own AS INTEGER) AS "cluster"
FROM pts_rows JOIN owned USING (g0, g1, g2)""",
    "hierarchical": f"""WITH RECURSIVE {RFM}, {METRIC_GRID}, {tree_cte("tree", "pts", K, 3)}
SELECT customer_id, recency, frequency, monetary, CAST(number AS INTEGER) AS "cluster"
FROM pts_rows JOIN tree USING (g0, g1, g2)""",
    "auto_k": sweep_sql(
        f"{RFM}, {METRIC_GRID}", KS, f"({SQUARED_GAP})", "squared_euclidean", "SELECT * FROM sweep"
    ),
    "auto_k_scores": sweep_sql(
        f"{SCORES}, {SCORE_GRID}", KS, f"sqrt({SQUARED_GAP})", "euclidean", "SELECT * FROM sweep"
    ),
    "best_k": sweep_sql(
        f"{SCORES}, {SCORE_GRID}", KS, f"sqrt({SQUARED_GAP})", "euclidean",
        "SELECT k, silhouette FROM sweep ORDER BY silhouette DESC, k LIMIT 1",
    ),
    "segment_settings": sweep_sql(
        f"{SCORES}, {SCORE_GRID}, {tree_cte('tree3', 'pts', 3, 3)}, {tree_cte('tree4', 'pts', 4, 3)}, {tree_cte('tree5', 'pts', 5, 3)}",
        range(3, 6), f"sqrt({SQUARED_GAP})", "euclidean",
        """, best AS (SELECT k FROM sweep ORDER BY silhouette DESC, k LIMIT 1)
SELECT customer_id, CAST(CASE (SELECT k FROM best) WHEN 3 THEN tree3.number
  WHEN 4 THEN tree4.number ELSE tree5.number END AS INTEGER) AS "cluster"
FROM pts_rows JOIN tree3 USING (g0, g1, g2) JOIN tree4 USING (g0, g1, g2) JOIN tree5 USING (g0, g1, g2)""",
    ),
    "segment_export": f"""WITH {RFM}, {SEGMENTS}
SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST("cluster" AS VARCHAR) AS "cluster",
  "Segment_label", CAST(recency AS VARCHAR) AS recency, CAST(frequency AS VARCHAR) AS frequency,
  CAST(CAST(monetary AS BIGINT) AS VARCHAR) AS monetary
FROM seg LEFT JOIN rfm USING (customer_id) WHERE "Segment_label" = '{CHOSEN_SEGMENT}'""",
    "dbscan": dbscan_sql(SCALED, 3, EPS),
    "hierarchical_single": dbscan_sql(SCALED, 3, LINK_HEIGHT, 1),
    "dbscan_six": dbscan_sql(SCALED_SIX, 6, EPS_SIX),
    "silhouette": _silhouette(
        f"""{SCORES}, points AS (SELECT customer_id AS id, "R_score" AS r, "F_score" AS f,
    "M_score" AS m, {_nearest(['"R_score"', '"F_score"', '"M_score"'], SCORE_CENTRES)} AS c
  FROM scored)""",
        "sqrt((a.r - b.r) * (a.r - b.r) + (a.f - b.f) * (a.f - b.f) + (a.m - b.m) * (a.m - b.m))",
        "euclidean",
    ),
    "silhouette_blocks": _silhouette(
        f"""{SCALED}, points AS (SELECT customer_id AS id, x0, x1, x2,
    {_nearest(["x0", "x1", "x2"], METRIC_CENTRES)} AS c FROM scaled)""",
        f"sqrt({SQUARED_GAP})",
        "euclidean",
    ),
    "silhouette_squared": _silhouette(
        f"""{SCALED}, points AS (SELECT customer_id AS id, x0, x1, x2,
    {_nearest(["x0", "x1", "x2"], METRIC_CENTRES)} AS c FROM scaled)""",
        "(a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)"
        " + (a.x2 - b.x2) * (a.x2 - b.x2)",
        "squared_euclidean",
    ),
}
