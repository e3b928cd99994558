"""The registered queries as plain SQL over the same tables, for an independent check."""

from shelfwatch import fixed_values as V

KEY = "organization, location, item"
DAY = "date, organization, location, item"


def digits(value: str) -> str:
    """The decimal digits of a double, so that it is rounded once."""
    return f"CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,20))"


def rnd(value: str, places: int = 2) -> str:
    return f"CAST(ROUND({digits(value)}, {places}) AS DOUBLE)"


def text1(value: str) -> str:
    return f"CAST(CAST(ROUND({digits(value)}, 1) AS DECIMAL(38,1)) AS VARCHAR)"


def sentence(wording: str, *values: str) -> str:
    """The fixed wording as a concatenation, each ``%s`` replaced by a value."""
    texts = [f"'{t}'" for t in wording.split("%s")]
    parts = [texts[0], *(x for pair in zip(values, texts[1:]) for x in pair)]
    return " || ".join(p for p in parts if p != "''")


def when(moment: str) -> str:
    return f"STRFTIME({moment}, '%Y-%m-%d %H:%M:%S.%f')"


# --- inputs --------------------------------------------------------------------

PARTS: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = body
    NEEDS[name] = list(needs)


def query(body: str, *needs: str) -> str:
    """``body`` behind the WITH parts it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS[name]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    with_list = ",\n".join(f"{n} AS ({PARTS[n]})" for n in order)
    return f"WITH {with_list}\n{body}" if order else body


part("site", "SELECT n_nationkey, r_name AS organization, n_name AS location FROM nation JOIN region ON n_regionkey = r_regionkey")
part(
    "shipped",
    """SELECT CAST(l_shipdate AS DATE) AS date, organization, location, p_type AS item,
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS received,
       CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS issued,
       CAST(SUM(l_orderkey) % 400 AS BIGINT) AS closing_stock,
       CAST(MIN(1 + (n_nationkey * 7 + LENGTH(p_type)) % 14) AS BIGINT) AS lead_time_days
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN site ON s_nationkey = n_nationkey
 GROUP BY 1, 2, 3, 4""",
    "site",
)
part(
    "ledger",
    f"SELECT {DAY}, closing_stock - received + issued AS opening_stock, received, issued, closing_stock, lead_time_days FROM shipped",
    "shipped",
)
part("means", f"SELECT {KEY}, AVG(issued) AS mean FROM ledger GROUP BY {KEY}", "ledger")
part(
    "judged",
    f"""SELECT ledger.*, mean, CASE WHEN mean = 0 THEN 9999e0 ELSE closing_stock / mean END AS days
  FROM ledger JOIN means USING ({KEY})""",
    "means",
)
part(
    "high",
    f"""SELECT {KEY}, closing_stock, {rnd('mean')} AS avg_daily_usage, {rnd('days')} AS days_left, lead_time_days, 'HIGH' AS risk_status
  FROM judged WHERE days <= lead_time_days""",
    "judged",
)


def newest_rows(source: str) -> str:
    order = "date, closing_stock, issued, received, opening_stock"
    newest = ", ".join(f"{c} DESC" for c in order.split(", "))
    return f"""SELECT *, AVG(issued) OVER w7 AS a7, AVG(issued) OVER w30 AS a30, MIN(issued) OVER w7 AS lo7,
       MAX(issued) OVER w7 AS hi7, STDDEV_SAMP(issued) OVER w7 AS sd7,
       ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY {newest}) AS age
  FROM {source}
 WINDOW w7 AS (PARTITION BY {KEY} ORDER BY {order} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
        w30 AS (PARTITION BY {KEY} ORDER BY {order} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


def stock_of(rolled: str) -> str:
    return f"""SELECT {KEY}, closing_stock, lead_time_days, {rnd('a7')} AS avg_daily_usage,
       CASE WHEN COALESCE(a7, 0) = 0 THEN 9999e0 ELSE {rnd('closing_stock / a7')} END AS days_left,
       CASE WHEN a7 <> 0 AND closing_stock / a7 <= lead_time_days THEN 'HIGH' ELSE 'NORMAL' END AS risk_status
  FROM {rolled} WHERE age = 1"""


def usage_of(rolled: str) -> str:
    cv = f"CASE WHEN a7 = 0 THEN 0e0 ELSE {rnd('sd7 / a7 * 100')} END"
    return f"""SELECT {KEY}, date AS last_data_date, {rnd('a7')} AS avg_daily_usage_7d, {rnd('a30')} AS avg_daily_usage_30d,
       lo7 AS min_usage_7d, hi7 AS max_usage_7d, {rnd('sd7')} AS usage_stddev_7d,
       CASE WHEN a7 > a30 * 1.1e0 THEN 'INCREASING' WHEN a7 < a30 * 0.9e0 THEN 'DECREASING' ELSE 'STABLE' END AS trend_direction,
       {cv} AS usage_volatility_pct,
       CASE WHEN {cv} > 50 THEN 'HIGHLY_VARIABLE' WHEN {cv} > 25 THEN 'VARIABLE' ELSE 'STABLE' END AS demand_pattern
  FROM {rolled} WHERE age = 1"""


def reorders_of(stock: str) -> str:
    return f"""SELECT {KEY}, closing_stock, avg_daily_usage, days_left, lead_time_days,
       GREATEST(0e0, {rnd('lead_time_days * avg_daily_usage - closing_stock', 0)}) AS reorder_qty,
       GREATEST(0e0, {rnd('(lead_time_days + 30) * avg_daily_usage - closing_stock', 0)}) AS reorder_qty_with_safety,
       CASE WHEN days_left <= 0 OR days_left <= lead_time_days * 0.5e0 THEN 'CRITICAL'
            WHEN days_left <= lead_time_days THEN 'HIGH'
            WHEN days_left <= lead_time_days * 1.5e0 THEN 'MEDIUM' ELSE 'LOW' END AS urgency_level,
       {rnd('lead_time_days * 2e0 + avg_daily_usage * 1.5e0 - closing_stock * 0.5e0')} AS priority_score
  FROM {stock}"""


part("rolled", newest_rows("ledger"), "ledger")
part("stock", stock_of("rolled"), "rolled")
part("usage", usage_of("rolled"), "rolled")
part("classified", reorders_of("stock"), "stock")
part("advice", "SELECT * FROM classified WHERE reorder_qty > 0", "classified")

part("ledger_old", "SELECT * FROM ledger WHERE date < DATE '2001-06-01' OR closing_stock % 97 = 0", "ledger")
part(
    "ledger_new",
    f"""SELECT {DAY}, opening_stock, received, issued + CASE WHEN closing_stock % 53 = 0 THEN 1 ELSE 0 END AS issued,
       closing_stock, lead_time_days
  FROM ledger WHERE closing_stock % 97 <> 0""",
    "ledger",
)
for version in ("old", "new"):
    part(f"rolled_{version}", newest_rows(f"ledger_{version}"), f"ledger_{version}")
    part(f"stock_{version}", stock_of(f"rolled_{version}"), f"rolled_{version}")
    part(f"advice_{version}", f"SELECT * FROM ({reorders_of(f'stock_{version}')}) WHERE reorder_qty > 0", f"stock_{version}")


def alerts_of(stock: str, advice: str) -> str:
    return f"""SELECT s.organization, s.location, s.item,
       CASE WHEN s.days_left <= 0 THEN 'CRITICAL_RISK' WHEN risk_status = 'HIGH' THEN 'HIGH_RISK'
            WHEN urgency_level = 'CRITICAL' THEN 'CRITICAL_RISK' ELSE 'REORDER_NEEDED' END AS alert_type,
       s.days_left, s.closing_stock, COALESCE(reorder_qty, 0e0) AS reorder_qty,
       COALESCE(priority_score, 0e0) AS priority_score, risk_status
  FROM {stock} s LEFT JOIN {advice} a USING ({KEY})
 WHERE risk_status = 'HIGH' OR s.days_left <= 3"""


BATCHES = range(4)
for n in BATCHES:
    arrived = f"LEAST(3, GREATEST(0, YEAR(date) - 1998)) <= {n}"
    part(f"ledger_b{n}", f"SELECT * FROM ledger WHERE {arrived}", "ledger")
    part(f"rolled_b{n}", newest_rows(f"ledger_b{n}"), f"ledger_b{n}")
    part(f"stock_b{n}", stock_of(f"rolled_b{n}"), f"rolled_b{n}")
    part(f"advice_b{n}", f"SELECT * FROM ({reorders_of(f'stock_b{n}')}) WHERE reorder_qty > 0", f"stock_b{n}")
    part(f"alerted_b{n}", alerts_of(f"stock_b{n}", f"advice_b{n}"), f"stock_b{n}", f"advice_b{n}")

part("alerted", alerts_of("stock", "advice"), "stock", "advice")
part("alerted_old", alerts_of("stock_old", "advice_old"), "stock_old", "advice_old")
part("alerted_new", alerts_of("stock_new", "advice_new"), "stock_new", "advice_new")

part(
    "diffed",
    """SELECT CASE WHEN o.date IS NULL THEN 'INSERT' WHEN n.date IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
       date, organization, location, item,
       o.opening_stock AS old_opening_stock, o.received AS old_received, o.issued AS old_issued,
       o.closing_stock AS old_closing_stock, o.lead_time_days AS old_lead_time_days,
       n.opening_stock AS new_opening_stock, n.received AS new_received, n.issued AS new_issued,
       n.closing_stock AS new_closing_stock, n.lead_time_days AS new_lead_time_days
  FROM ledger_old o FULL JOIN ledger_new n USING (date, organization, location, item)
 WHERE o.date IS NULL OR n.date IS NULL
    OR (o.opening_stock, o.received, o.issued, o.closing_stock, o.lead_time_days)
       <> (n.opening_stock, n.received, n.issued, n.closing_stock, n.lead_time_days)""",
    "ledger_old",
    "ledger_new",
)
QUANTITIES = ["opening_stock", "received", "issued", "closing_stock", "lead_time_days"]
MONTHLY = "SELECT * REPLACE (CAST(DATE_TRUNC('month', date) AS DATE) AS date) FROM ledger_{}"
for name, one, other in (("gone_rows", "old", "new"), ("come_rows", "new", "old")):
    part(
        name,
        f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY {DAY} ORDER BY {', '.join(QUANTITIES)}) AS nth
  FROM ({MONTHLY.format(one)} EXCEPT ALL {MONTHLY.format(other)})""",
        "ledger_old",
        "ledger_new",
    )
part(
    "stock_diffed",
    f"""SELECT CASE WHEN o.risk_status IS NULL THEN 'INSERT' WHEN n.risk_status IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
       {KEY}, o.closing_stock AS old_closing_stock, o.lead_time_days AS old_lead_time_days,
       o.avg_daily_usage AS old_avg_daily_usage, o.days_left AS old_days_left, COALESCE(o.risk_status, '') AS old_risk_status,
       n.closing_stock AS new_closing_stock, n.lead_time_days AS new_lead_time_days,
       n.avg_daily_usage AS new_avg_daily_usage, n.days_left AS new_days_left, COALESCE(n.risk_status, '') AS new_risk_status
  FROM stock_old o FULL JOIN stock_new n USING ({KEY})
 WHERE o.risk_status IS NULL OR n.risk_status IS NULL
    OR (o.closing_stock, o.lead_time_days, o.avg_daily_usage, o.days_left, o.risk_status)
       <> (n.closing_stock, n.lead_time_days, n.avg_daily_usage, n.days_left, n.risk_status)""",
    "stock_old",
    "stock_new",
)

part(
    "upload",
    """SELECT CASE WHEN closing_stock % 101 = 0 THEN '2001-13-45' ELSE CAST(date AS VARCHAR) END AS date,
       organization, CASE WHEN closing_stock % 103 <> 0 THEN location END AS location, item || ', boxed' AS item,
       CAST(opening_stock AS VARCHAR) AS opening_stock,
       CASE WHEN received % 89 = 7 THEN 'abc' ELSE CAST(received AS VARCHAR) END AS received,
       CASE WHEN closing_stock % 97 = 5 THEN '-1' ELSE CAST(issued AS VARCHAR) END AS issued,
       CAST(closing_stock + CASE WHEN closing_stock % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS closing_stock,
       CAST(lead_time_days AS VARCHAR) || '.0' AS lead_time_days
  FROM ledger""",
    "ledger",
)
part(
    "typed",
    """SELECT date, TRY_CAST(date AS DATE) AS day, organization, location, item,
       TRY_CAST(opening_stock AS DOUBLE) AS opening, TRY_CAST(received AS DOUBLE) AS got, TRY_CAST(issued AS DOUBLE) AS used,
       TRY_CAST(closing_stock AS DOUBLE) AS closing, TRY_CAST(lead_time_days AS DOUBLE) AS lead
  FROM upload""",
    "upload",
)
COLUMN_OF = {"opening": "opening_stock", "got": "received", "used": "issued", "closing": "closing_stock", "lead": "lead_time_days"}


def finding(rule: str, severity: str, column: str, broken: str) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, '{column}' AS \"column\", COUNT(*) AS count FROM typed WHERE {broken}"


FINDINGS = {
    "bad_date": [finding("bad_date", "error", "date", "date IS NOT NULL AND day IS NULL")],
    "empty_date": [finding("empty_date", "warning", "date", "date IS NULL")],
    "not_numeric": [finding("not_numeric", "error", c, f"{x} IS NULL") for x, c in COLUMN_OF.items()],
    "negative": [finding("negative", "error", c, f"{x} < 0") for x, c in COLUMN_OF.items()],
    "fraction": [finding("fraction", "warning", c, f"{x} <> FLOOR({x})") for x, c in COLUMN_OF.items()],
    "empty_name": [finding("empty_name", "error", c, f"{c} IS NULL") for c in ("organization", "location", "item")],
    "closing_mismatch": [
        finding("closing_mismatch", "warning", "closing_stock", "COALESCE(closing <> opening + got - used, TRUE)")
    ],
}


def findings(*rules: str) -> str:
    chosen = [sql for rule in (rules or FINDINGS) for sql in FINDINGS[rule]]
    return query(f"SELECT * FROM ({' UNION ALL '.join(chosen)}) WHERE count > 0", "typed")


part(
    "lines",
    "SELECT l_orderkey, MIN(p_type) AS item, SUM(l_quantity) AS ordered_qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
)
part(
    "placed",
    """SELECT o_orderkey AS order_id, organization, location, item, CAST(o_orderdate AS DATE) AS order_date, ordered_qty,
       CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'SHIPPED' ELSE 'RECEIVED' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority_level,
       CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 14 AS INTEGER) AS expected_delivery_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN site ON c_nationkey = n_nationkey JOIN lines ON l_orderkey = o_orderkey""",
    "site",
    "lines",
)
part("today", "SELECT * FROM placed WHERE order_date = (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders)", "placed")
part("ordered_items", f"SELECT DISTINCT {KEY} FROM today", "today")

part(
    "actions",
    """SELECT event_id AS action_id,
       CASE event_type WHEN 'purchase' THEN 'ORDER_PLACED' WHEN 'view' THEN 'ITEM_REVIEWED' WHEN 'click' THEN 'PDF_EXPORTED'
            WHEN 'signup' THEN 'DATA_UPLOADED' ELSE 'CONFIG_CHANGED' END AS action_type,
       ts AS action_timestamp, 'user_' || user_id AS user_name, 's_' || user_id || '_' || CAST(ts AS DATE) AS session_id,
       CAST(FLOOR(value * 10) AS BIGINT) AS response_time_ms, props AS action_details,
       CASE WHEN event_id % 4 = 0 THEN 'Dashboard' ELSE 'Data' END AS source_page,
       CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status
  FROM events""",
)
part(
    "runs",
    """SELECT event_id AS log_id, 'TASK_' || UPPER(event_type) AS task_name, ts AS execution_time,
       CASE WHEN event_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, user_id AS records_processed,
       CASE WHEN event_id % 10 = 0 THEN 'synthetic failure' END AS error_message, value AS execution_duration_seconds
  FROM events""",
)
COUNTERS = """COUNT(*) FILTER (action_type = 'ITEM_REVIEWED') AS items_reviewed,
       COUNT(*) FILTER (action_type = 'ORDER_PLACED') AS items_ordered,
       COUNT(*) FILTER (action_type = 'PDF_EXPORTED') AS pdfs_exported,
       COUNT(*) FILTER (action_type = 'DATA_UPLOADED') AS data_uploads"""
part(
    "visits",
    f"""SELECT session_id, MAX(user_name) AS user_name, MIN(action_timestamp) AS session_start, MAX(action_timestamp) AS last_activity,
       COUNT(*) AS actions_count, STRING_AGG(DISTINCT source_page, ',' ORDER BY source_page) AS pages_visited, {COUNTERS}
  FROM actions GROUP BY session_id""",
    "actions",
)
part(
    "endings",
    "SELECT session_id, MAX(action_timestamp) AS session_end FROM actions WHERE action_type = 'CONFIG_CHANGED' GROUP BY session_id",
    "actions",
)


def recently(table: str, column: str, hours: int) -> str:
    return f"{column} >= (SELECT MAX({column}) FROM {table}) - INTERVAL {hours} HOUR"


WEEK = 7 * 24

CRITICALITY = """GREATEST(3, CASE WHEN CONTAINS(location, 'NATION_1') THEN 12 ELSE 3 END,
       CASE item WHEN 'PROMO' THEN 7 WHEN 'ECONOMY' THEN 5 ELSE 3 END)"""
SCORED = rnd(f"lead_time_days * 2e0 + avg_daily_usage * 1.5e0 + {CRITICALITY} - closing_stock * 0.5e0")
part("scored", f"SELECT *, {SCORED} AS priority_score FROM high", "high")

NEED = "GREATEST(0e0, lead_time_days * mean - closing_stock)"
URGENT3 = """CASE WHEN days <= 0 OR days <= lead_time_days * 0.5e0 THEN 'CRITICAL' WHEN days <= lead_time_days THEN 'HIGH' ELSE 'MEDIUM' END"""
part(
    "needed",
    f"""SELECT {KEY}, closing_stock, {rnd('mean')} AS avg_daily_usage, {rnd('days')} AS days_left, lead_time_days,
       {rnd(NEED, 0)} AS reorder_qty, {URGENT3} AS urgency_level
  FROM judged WHERE {NEED} > 0""",
    "judged",
)

MONTH_ORDER = "GREATEST(10, CAST(TRUNC(avg_daily_usage * 30) AS BIGINT) - closing_stock)"


def projected(source: str, wanted: str) -> str:
    return f"""SELECT *, closing_stock + order_qty AS projected_stock,
       CASE WHEN avg_daily_usage > 0 THEN closing_stock / avg_daily_usage ELSE 9999e0 END AS before,
       CASE WHEN avg_daily_usage > 0 THEN (closing_stock + order_qty) / avg_daily_usage ELSE 9999e0 END AS after
  FROM (SELECT *, CAST({wanted} AS BIGINT) AS order_qty FROM {source})"""


BAD_LINE = "(closing % 89 = 3 OR closing % 83 = 2)"
SOUND = "(day IS NOT NULL AND location IS NOT NULL AND opening >= 0 AND got >= 0 AND used >= 0 AND closing >= 0 AND lead >= 0)"
part(
    "all_rules",
    """SELECT 'location' AS kind, n_name AS value, CAST(n_nationkey % 17 AS INTEGER) AS score FROM nation
 UNION ALL SELECT 'item', type, CAST(first_key % 20 AS INTEGER)
  FROM (SELECT MIN(p_partkey) AS first_key, UNNEST(LIST(DISTINCT p_type)) AS type FROM part GROUP BY p_name, p_brand)""",
)
part("file_rules", "SELECT * FROM all_rules WHERE score BETWEEN 1 AND 15", "all_rules")

ROLLED = f"SELECT {DAY}, {{}} FROM rolled"
GRID = ", ".join(
    f"CAST(COALESCE(SUM(closing_stock) FILTER (location = 'NATION_{i}'), 0) AS BIGINT) AS NATION_{i}" for i in range(25)
)

ORACLES: dict[str, str] = {
    "s_ledger": query("SELECT * FROM ledger", "ledger"),
    "s_fullload": query("SELECT * FROM ledger", "ledger"),
    "s_csv": query("SELECT * FROM ledger", "ledger"),
    "s_normcols": query("SELECT * FROM ledger", "ledger"),
    "s_badrows": query(
        f"""SELECT day AS date, {KEY}, CAST(opening AS BIGINT) AS opening_stock, CAST(got AS BIGINT) AS received,
       CAST(used AS BIGINT) AS issued, CAST(closing AS BIGINT) AS closing_stock, CAST(lead AS BIGINT) AS lead_time_days
  FROM typed WHERE NOT {BAD_LINE} AND {SOUND}""",
        "typed",
    ),
    "s_rejected": query(
        f"""SELECT {BAD_LINE} AS bad_line, COUNT(*) AS rows FROM typed WHERE {BAD_LINE} OR NOT COALESCE({SOUND}, FALSE) GROUP BY 1""",
        "typed",
    ),
    "s_profile_rejected": "SELECT r_name AS organization, 'no goods_type' AS reason FROM region WHERE r_regionkey = 3",
    "s_rules": query(
        f"""SELECT {DAY}, GREATEST(3, COALESCE(place_score, 0), COALESCE(item_score, 0)) AS criticality
  FROM ledger LEFT JOIN (SELECT n_name AS location, MAX(score) AS place_score
                           FROM nation JOIN file_rules ON kind = 'location' AND CONTAINS(n_name, value) GROUP BY n_name) USING (location)
       LEFT JOIN (SELECT value AS item, MAX(score) AS item_score FROM file_rules WHERE kind = 'item' GROUP BY value) USING (item)""",
        "ledger",
        "file_rules",
    ),
    "s_rules_rejected": query("SELECT * FROM all_rules WHERE score NOT BETWEEN 1 AND 15", "all_rules"),
    "s_profile": query(
        f"""SELECT {KEY}, closing_stock,
       CASE WHEN r_regionkey = 3 THEN '' ELSE ['Hospital', 'NGO', 'Government', 'Private', 'Other'][r_regionkey + 1] END AS sector,
       CASE WHEN r_regionkey = 3 THEN '' ELSE 'Region ' || r_regionkey END AS region
  FROM stock JOIN region ON r_name = organization""",
        "stock",
    ),
    "s_export": query(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY priority_score DESC, {KEY}, closing_stock) AS priority, item, organization, location,
       {text1('days_left')} AS days_left, {text1('priority_score')} AS score
  FROM scored QUALIFY priority <= 3""",
        "scored",
    ),
    "p_slice": query(
        f"SELECT {DAY}, closing_stock, {rnd('mean', 4)} AS avg_usage FROM judged WHERE organization = 'ASIA' AND item = 'PROMO'",
        "judged",
    ),
    "p_daysleft": query(f"SELECT {DAY}, {rnd('days', 4)} AS days_left FROM judged", "judged"),
    "p_risk": query(
        f"SELECT {DAY}, CASE WHEN days <= lead_time_days THEN 'HIGH' ELSE 'NORMAL' END AS risk_status FROM judged", "judged"
    ),
    "p_urg3": query(f"SELECT {DAY}, {URGENT3} AS urgency_level FROM judged", "judged"),
    "p_urg4": query(f"SELECT {KEY}, days_left, urgency_level FROM classified", "classified"),
    "p_reorder": query(f"SELECT {DAY}, {rnd(NEED, 4)} AS reorder_qty FROM judged", "judged"),
    "p_safety": query(f"SELECT {KEY}, reorder_qty, reorder_qty_with_safety FROM classified", "classified"),
    "p_score": query(f"SELECT {KEY}, priority_score FROM classified", "classified"),
    "p_crit": query(f"SELECT {DAY}, {CRITICALITY} AS criticality FROM ledger", "ledger"),
    "p_scorec": query(f"SELECT {KEY}, {SCORED} AS priority_score FROM stock", "stock"),
    "p_explain": query(
        f"""SELECT {KEY}, {sentence(V.ALERT_SENTENCE, 'item', 'organization', 'location', text1('avg_daily_usage'), 'lead_time_days', text1('days_left'))} AS explanation
  FROM stock WHERE risk_status = 'HIGH'""",
        "stock",
    ),
    "p_action": query(
        f"""SELECT {KEY}, {sentence(V.ACTION_SENTENCE, 'item', 'organization', 'location')} AS action
  FROM stock WHERE risk_status = 'HIGH'""",
        "stock",
    ),
    "p_whatif": query(
        f"""SELECT {KEY}, order_qty, COALESCE(asked NOT BETWEEN 0 AND 10000, FALSE) AS qty_out_of_range,
       projected_stock, {rnd('before')} AS current_days, {rnd('after')} AS projected_days,
       {rnd('after - before')} AS days_gained
  FROM ({projected(f'(SELECT * FROM stock LEFT JOIN (SELECT {KEY}, CAST(SUM(ordered_qty) * 100 AS BIGINT) AS asked FROM today GROUP BY {KEY}) USING ({KEY}))', f'COALESCE(asked, {MONTH_ORDER})')})""",
        "stock",
        "today",
    ),
    "p_cover": query(
        f"""SELECT {KEY}, closing_stock, order_qty, {rnd('after')} AS projected_days,
       CASE WHEN after > lead_time_days * 2 THEN 'SAFE' WHEN after > lead_time_days THEN 'MODERATE' ELSE 'HIGH' END AS cover_level
  FROM ({projected('(SELECT * REPLACE (avg_daily_usage * 1000 AS avg_daily_usage) FROM high)', MONTH_ORDER)})""",
        "high",
    ),
    "p_target": query(
        f"""SELECT {KEY}, closing_stock, {rnd('GREATEST(0e0, avg_daily_usage * 60 - closing_stock)')} AS qty_60_days,
       {rnd('GREATEST(0e0, avg_daily_usage * 90 - closing_stock)')} AS qty_90_days FROM high""",
        "high",
    ),
    "p_trend": query(f"SELECT {KEY}, trend_direction FROM usage", "usage"),
    "p_cv": query(f"SELECT {KEY}, usage_volatility_pct FROM usage", "usage"),
    "p_pattern": query(
        f"""SELECT {KEY}, usage_volatility_pct, demand_pattern
  FROM ({usage_of(f"({newest_rows('(SELECT * REPLACE (issued + 40 AS issued) FROM ledger)')})")})""",
        "ledger",
    ),
    "p_alerttype": query(f"SELECT {KEY}, alert_type, days_left FROM alerted", "alerted"),
    "j_latest": query("SELECT * FROM ledger WHERE date = (SELECT MAX(date) FROM ledger)", "ledger"),
    "j_enrich": query(
        f"""SELECT {KEY}, s.closing_stock, reorder_qty, COALESCE(urgency_level, '') AS urgency_level
  FROM stock s LEFT JOIN advice a USING ({KEY})""",
        "stock",
        "advice",
    ),
    "j_notalerted": query(
        f"""SELECT {KEY}, alert_type, days_left, closing_stock, reorder_qty, priority_score FROM alerted_new n
 WHERE risk_status = 'HIGH' OR NOT EXISTS (SELECT 1 FROM alerted_old o
       WHERE (o.organization, o.location, o.item) = (n.organization, n.location, n.item))""",
        "alerted_new",
        "alerted_old",
    ),
    "j_unordered": query(f"SELECT {KEY}, closing_stock FROM stock ANTI JOIN ordered_items USING ({KEY})", "stock", "ordered_items"),
    "j_ordered": query(
        f"""SELECT {KEY}, closing_stock, hit IS NOT NULL AS ordered
  FROM stock LEFT JOIN (SELECT *, 1 AS hit FROM ordered_items) USING ({KEY})""",
        "stock",
        "ordered_items",
    ),
    "j_ordered_list": query(
        f"SELECT {KEY}, closing_stock, avg_daily_usage, priority_score FROM scored SEMI JOIN ordered_items USING ({KEY})",
        "scored",
        "ordered_items",
    ),
    "j_diff": query("SELECT * FROM diffed", "diffed"),
    "j_diff_repeated": query(
        f"""SELECT CASE WHEN o.nth IS NULL THEN 'INSERT' WHEN n.nth IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, {DAY},
       {', '.join(f'{side}.{c} AS {name}_{c}' for side, name in (('o', 'old'), ('n', 'new')) for c in QUANTITIES)}
  FROM gone_rows o FULL JOIN come_rows n USING ({DAY}, nth)""",
        "gone_rows",
        "come_rows",
    ),
    "q_overview": query(
        """SELECT COUNT(DISTINCT organization) AS total_organizations, COUNT(DISTINCT item) AS total_items,
       CAST(SUM(CASE WHEN days <= lead_time_days THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count FROM judged""",
        "judged",
    ),
    "q_high_series": query(f"SELECT {KEY}, COUNT(*) AS high_rows FROM high GROUP BY {KEY}", "high"),
    "a_heat": query(
        "SELECT item, location, CAST(SUM(closing_stock) AS BIGINT) AS total_closing_stock FROM ledger GROUP BY item, location",
        "ledger",
    ),
    "a_pivot": query(f"SELECT item, {GRID} FROM ledger GROUP BY item", "ledger"),
    "a_urgsum": query(
        "SELECT urgency_level, SUM(reorder_qty) AS total_reorder_qty, COUNT(*) AS number_of_items FROM needed GROUP BY urgency_level",
        "needed",
    ),
    "a_summary": query(
        f"""SELECT (SELECT MAX(date) FROM ledger) AS summary_date, 0 AS summary_hour,
       COUNT(DISTINCT organization) AS total_organizations, COUNT(DISTINCT item) AS total_items,
       COUNT(*) FILTER (risk_status = 'HIGH') AS high_risk_count, COUNT(*) FILTER (s.days_left <= 0) AS critical_risk_count,
       COALESCE(SUM(reorder_qty), 0e0) AS total_reorder_qty
  FROM stock s LEFT JOIN advice a USING ({KEY})""",
        "stock",
        "advice",
    ),
    "a_runperf": query(
        f"""SELECT task_name, {rnd('AVG(execution_duration_seconds)', 4)} AS avg_duration, MAX(execution_duration_seconds) AS max_duration,
       COUNT(*) AS executions, COUNT(*) FILTER (status = 'SUCCESS') AS successful
  FROM runs WHERE {recently('runs', 'execution_time', WEEK)} GROUP BY task_name""",
        "runs",
    ),
    "a_runrate": query(
        f"""SELECT task_name, COUNT(*) AS total_executions, COUNT(*) FILTER (status = 'SUCCESS') AS successful,
       COUNT(*) FILTER (status = 'FAILED') AS failed, {rnd('AVG(execution_duration_seconds)')} AS avg_duration_sec
  FROM runs WHERE {recently('runs', 'execution_time', WEEK)} GROUP BY task_name""",
        "runs",
    ),
    "a_actstats": query(
        f"""SELECT action_type, COUNT(*) AS count, {rnd('AVG(response_time_ms)', 4)} AS avg_response_ms
  FROM actions WHERE {recently('actions', 'action_timestamp', 24)} GROUP BY action_type""",
        "actions",
    ),
    "a_actusers": query(
        f"""SELECT action_type, COUNT(*) AS action_count, COUNT(DISTINCT user_name) AS unique_users
  FROM actions WHERE {recently('actions', 'action_timestamp', WEEK)} GROUP BY action_type""",
        "actions",
    ),
    "a_resp": query(
        f"""SELECT {rnd('AVG(response_time_ms)', 4)} AS avg_response_ms, MIN(response_time_ms) AS min_response_ms,
       MAX(response_time_ms) AS max_response_ms, COUNT(*) AS total_actions
  FROM actions WHERE {recently('actions', 'action_timestamp', 1)}""",
        "actions",
    ),
    "a_avguse": query(f"SELECT {KEY}, {rnd('COALESCE(mean, 0)', 4)} AS avg_daily_usage FROM means", "means"),
    "a_maxid": "SELECT MAX(event_id) AS last_id FROM events",
    "a_pending": query("SELECT COUNT(*) AS pending_changes FROM diffed", "diffed"),
    "w_avgall": query(
        f"SELECT {DAY}, {rnd(f'AVG(issued) OVER (PARTITION BY {KEY})', 4)} AS avg_usage FROM ledger", "ledger"
    ),
    "w_avg7": query(ROLLED.format(f"{rnd('a7', 4)} AS avg_7"), "rolled"),
    "w_avg30": query(ROLLED.format(f"{rnd('a30', 4)} AS avg_30"), "rolled"),
    "w_minmax7": query(ROLLED.format("lo7 AS min_7, hi7 AS max_7"), "rolled"),
    "w_std7": query(ROLLED.format(f"{rnd('sd7', 4)} AS std_7"), "rolled"),
    "w_recent": query(
        f"""SELECT {DAY}, opening_stock, received, issued, closing_stock, lead_time_days FROM rolled WHERE age = 1""", "rolled"
    ),
    "q_alerts": query("SELECT * FROM high", "high"),
    "q_alerts_page": query(
        f"""SELECT scored.*, hit IS NOT NULL AS ordered
  FROM scored LEFT JOIN (SELECT *, 1 AS hit FROM ordered_items) USING ({KEY})""",
        "scored",
        "ordered_items",
    ),
    "q_reorder": query("SELECT * FROM needed", "needed"),
    "q_actions": query(
        f"""SELECT * EXCLUDE (risk_status), {sentence(V.ACTION_SENTENCE, 'item', 'organization', 'location')} AS action
  FROM scored ANTI JOIN ordered_items USING ({KEY}) ORDER BY priority_score DESC, {KEY}, closing_stock LIMIT {V.TOP_ACTIONS}""",
        "scored",
        "ordered_items",
    ),
    "q_calc": query("SELECT * EXCLUDE (risk_status) FROM high", "high"),
    "m_stock": query("SELECT *, (SELECT MAX(date) FROM ledger) AS last_updated FROM stock", "stock"),
    "m_reorder": query("SELECT * FROM advice", "advice"),
    "m_usage": query("SELECT * FROM usage", "usage"),
    "q_risktop": query(
        f"""SELECT {KEY}, closing_stock, days_left, risk_status FROM stock WHERE risk_status = 'HIGH'
 ORDER BY days_left, {KEY} LIMIT {V.TOP_LIST}""",
        "stock",
    ),
    "q_rectop": query(
        f"""SELECT {KEY}, reorder_qty, urgency_level, priority_score FROM advice WHERE urgency_level IN ('CRITICAL', 'HIGH')
 ORDER BY priority_score DESC, {KEY} LIMIT {V.TOP_LIST}""",
        "advice",
    ),
    "q_rising": query(
        f"""SELECT organization, item, avg_daily_usage_7d, avg_daily_usage_30d, trend_direction, demand_pattern
  FROM usage WHERE trend_direction = 'INCREASING' ORDER BY avg_daily_usage_7d DESC, {KEY} LIMIT {V.TOP_LIST}""",
        "usage",
    ),
    "o_sort": query(
        f"""SELECT *, ROW_NUMBER() OVER (ORDER BY CASE urgency_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END,
       days_left, {KEY}, closing_stock, reorder_qty) AS place FROM needed""",
        "needed",
    ),
    "o_topk": query(f"SELECT * FROM scored ORDER BY priority_score DESC, {KEY}, closing_stock LIMIT {V.TOP_ALERTS}", "scored"),
    "o_preview": query(f"SELECT * FROM ledger ORDER BY {DAY}, closing_stock LIMIT {V.PREVIEW_ROWS}", "ledger"),
    "o_last7": query(
        f"""SELECT {KEY}, STRING_AGG(CAST(date AS VARCHAR), ',' ORDER BY age DESC) AS dates,
       STRING_AGG(CAST(closing_stock AS VARCHAR), ',' ORDER BY age DESC) AS closing_stocks
  FROM rolled WHERE age <= 7 GROUP BY {KEY} HAVING COUNT(*) >= 2""",
        "rolled",
    ),
    "o_distinct": query(
        " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS name_of, {c} AS name FROM ledger" for c in KEY.split(", ")), "ledger"
    ),
    "o_logtail": query(
        f"""SELECT * REPLACE ({when('execution_time')} AS execution_time) FROM runs WHERE status = 'FAILED'
 ORDER BY runs.execution_time DESC, log_id DESC LIMIT {V.TOP_LIST}""",
        "runs",
    ),
    "v_date": findings("bad_date"),
    "v_num": findings("not_numeric"),
    "v_neg": findings("negative"),
    "v_formula": findings("closing_mismatch"),
    "v_blank": findings("empty_name"),
    "v_report": findings(),
    "v_negclose": query("SELECT COUNT(*) FILTER (closing_stock - issued < 0) AS negative_closing FROM ledger", "ledger"),
    "v_parity": query(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", COUNT(*) FILTER (ok) AS matching, COUNT(*) FILTER (NOT ok) AS mismatching
  FROM (SELECT COALESCE(ABS(o.{c} - n.{c}) <= 0.01e0, FALSE) AS ok FROM stock_old o FULL JOIN stock_new n USING ({KEY}))"""
            for c in ("closing_stock", "avg_daily_usage", "days_left")
        ),
        "stock_old",
        "stock_new",
    ),
    "l_recent": query(
        f"""SELECT * REPLACE ({when('action_timestamp')} AS action_timestamp) FROM actions
 WHERE {recently('actions', 'actions.action_timestamp', 24)} ORDER BY actions.action_timestamp DESC, action_id DESC LIMIT 100""",
        "actions",
    ),
    "l_sessions": query(
        f"""SELECT * REPLACE ({when('session_start')} AS session_start, {when('last_activity')} AS last_activity) FROM visits""",
        "visits",
    ),
    "l_close": query(
        f"""SELECT session_id, {when('session_end')} AS session_end, FALSE AS is_active,
       DATE_DIFF('minute', session_start, session_end) AS session_duration_minutes FROM visits JOIN endings USING (session_id)""",
        "visits",
        "endings",
    ),
    "l_active": query(
        f"""SELECT session_id, user_name, {when('session_start')} AS session_start, {when('last_activity')} AS last_activity,
       DATE_DIFF('minute', v.session_start, v.last_activity) AS minutes_active, pages_visited, actions_count, items_ordered
  FROM visits v ANTI JOIN endings USING (session_id)""",
        "visits",
        "endings",
    ),
    "l_pending": query(
        f"""SELECT order_id, {KEY}, order_date, ordered_qty, priority_level, expected_delivery_date,
       DATE_DIFF('day', (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders), expected_delivery_date) AS days_until_delivery
  FROM placed WHERE status IN ('PENDING', 'SHIPPED')""",
        "placed",
    ),
    "l_orders": query(
        f"""SELECT order_id, {KEY}, DATE '2001-12-01' AS order_date, '2001-12-01 08:30:00.000000' AS order_timestamp,
       'user_' || order_id AS ordered_by, ordered_qty, 'PENDING' AS status, priority_level,
       '2001-12-01 08:30:00.000000' AS created_at FROM placed""",
        "placed",
    ),
    "l_equal_orders": query("SELECT 2 * COUNT(*) AS orders, 2 * COUNT(*) AS ids, 2 * COUNT(*) AS replayed FROM placed", "placed"),
    "l_order_actions": query(
        f"""SELECT 'ORDER_PLACED' AS action_type, 'user_' || order_id AS user_name, {KEY},
       '{{"order_id":' || order_id || ',"quantity":' || CAST(ordered_qty AS VARCHAR) || '}}' AS action_details FROM placed""",
        "placed",
    ),
    "l_actions": query(
        f"""SELECT 'ORDER_PLACED' AS action_type, 'user_' || order_id AS user_name, {KEY},
       '{{"order_id":' || order_id || ',"quantity":' || CAST(ordered_qty AS VARCHAR) || '}}' AS action_details,
       'Dashboard' AS source_page, 'SUCCESS' AS status FROM placed""",
        "placed",
    ),
    "l_details": query(
        "SELECT action_id, action_type, CAST(regexp_extract(action_details, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM actions",
        "actions",
    ),
    "l_runhist": query(
        f"""SELECT * REPLACE ({when('execution_time')} AS execution_time, COALESCE(error_message, '') AS error_message) FROM runs
 WHERE task_name = 'TASK_VIEW' AND {recently('runs', 'runs.execution_time', 24)}
 ORDER BY runs.execution_time DESC, log_id DESC LIMIT 100""",
        "runs",
    ),
    "l_fresh": query(
        f"""SELECT task_name, status AS state, {when('execution_time')} AS last_refresh_start,
       {when('execution_time + CAST(ROUND(execution_duration_seconds * 1000000) AS BIGINT) * INTERVAL 1 MICROSECOND')} AS last_refresh_end
  FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY task_name ORDER BY execution_time DESC, log_id DESC) = 1""",
        "runs",
    ),
    "l_health": query(
        """SELECT CASE WHEN task_name IN ('TASK_CLICK', 'TASK_VIEW') THEN 'table' ELSE 'task' END AS kind, task_name AS component,
       status AS state, 0 AS pending_changes, status = 'SUCCESS' AS healthy
  FROM (SELECT * FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY task_name ORDER BY execution_time DESC, log_id DESC) = 1)
 UNION ALL SELECT 'feed', 'ledger_changes', CASE WHEN COUNT(*) > 0 THEN 'HAS_DATA' ELSE 'EMPTY' END, COUNT(*), TRUE FROM diffed
 UNION ALL SELECT 'feed', 'stock_changes', CASE WHEN COUNT(*) > 0 THEN 'HAS_DATA' ELSE 'EMPTY' END, COUNT(*), TRUE FROM stock_diffed""",
        "runs",
        "diffed",
        "stock_diffed",
    ),
    "t_cdc": query(
        f"""SELECT 'DELETE' AS action, op = 'UPDATE' AS is_update, 1 AS rows, {DAY}, old_opening_stock AS opening_stock,
       old_received AS received, old_issued AS issued, old_closing_stock AS closing_stock, old_lead_time_days AS lead_time_days
  FROM diffed WHERE op <> 'INSERT'
 UNION ALL SELECT 'INSERT', op = 'UPDATE', 1, {DAY}, new_opening_stock, new_received, new_issued, new_closing_stock, new_lead_time_days
  FROM diffed WHERE op <> 'DELETE'""",
        "diffed",
    ),
    "t_acdc": query("SELECT * FROM stock_diffed", "stock_diffed"),
    "t_recompute": query("SELECT * FROM stock_new", "stock_new"),
    "t_alerts": query(
        f"""SELECT {KEY}, alert_type, days_left, closing_stock, reorder_qty, priority_score, (SELECT MAX(date) FROM ledger) AS alert_date
  FROM alerted_new ANTI JOIN alerted_old USING ({KEY})""",
        "alerted_new",
        "alerted_old",
    ),
    "t_retain": query("SELECT * FROM ledger WHERE date >= (SELECT MAX(date) FROM ledger) - INTERVAL 180 DAY", "ledger"),
    "t_expired": query(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, COUNT(*) FILTER (date < (SELECT MAX(date) FROM ledger) - INTERVAL {days} DAY) AS expired FROM ledger"
            for kind, days in (("summaries", 90), ("alerts", 180), ("runs", 30))
        ),
        "ledger",
    ),
    "t_sessions": query(
        f"""SELECT session_id, MAX(user_name) AS user_name, {when('MIN(action_timestamp)')} AS session_start,
       {when('MAX(action_timestamp)')} AS last_activity, COUNT(*) AS actions_count, {COUNTERS},
       MAX(action_timestamp) + INTERVAL 30 MINUTE >= (SELECT MAX(action_timestamp) FROM actions) AS is_open
  FROM (SELECT *, SUM(fresh) OVER (PARTITION BY session_id ORDER BY action_timestamp, action_id) AS visit
          FROM (SELECT *, CASE WHEN action_timestamp - LAG(action_timestamp) OVER (PARTITION BY session_id ORDER BY action_timestamp, action_id)
                                    <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM actions))
 GROUP BY session_id, visit""",
        "actions",
    ),
}
ORACLES["l_runlog"] = query(
    "SELECT 'keep_actions' AS task_name, 'SUCCESS' AS status, COUNT(*) AS records_processed, 0 AS incomplete FROM actions", "actions"
)
part(
    "restated",
    "SELECT * FROM ledger WHERE DATE_TRUNC('month', date) = DATE '1998-03-01' AND closing_stock % 53 = 0",
    "ledger",
)
ORACLES["t_cdc_leaves"] = query(
    "SELECT 'DELETE' AS action, TRUE AS is_update, 1 AS rows, * FROM restated"
    " UNION ALL SELECT 'INSERT', TRUE, 1, * REPLACE (issued + 1 AS issued) FROM restated",
    "restated",
)
ORACLES["v_cols"] = query(
    "SELECT 'missing_column' AS rule, 'error' AS severity, \"column\", 1 AS count FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM upload HAVING COUNT(*) > COUNT({c})" for c in f"{DAY}, {', '.join(QUANTITIES)}".split(", "))
    + ")",
    "upload",
)
ORACLES["v_empty"] = query(
    "SELECT 'no_rows' AS rule, 'error' AS severity, '' AS \"column\", 1 AS count FROM upload WHERE date > '9999' HAVING COUNT(*) = 0", "upload"
)
part("months_old", "SELECT * REPLACE (CAST(DATE_TRUNC('month', date) AS DATE) AS date) FROM ledger_old", "ledger_old")
part("months_new", "SELECT * REPLACE (CAST(DATE_TRUNC('month', date) AS DATE) AS date) FROM ledger_new", "ledger_new")
ORACLES["v_parity_repeated"] = query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(SUM(alike) AS BIGINT) AS matching, CAST(SUM(most - alike) AS BIGINT) AS mismatching
  FROM (SELECT SUM(LEAST(o, n)) AS alike, GREATEST(SUM(o), SUM(n)) AS most
          FROM (SELECT {DAY}, {c}, SUM(o) AS o, SUM(n) AS n
                  FROM (SELECT {DAY}, {c}, 1 AS o, 0 AS n FROM months_old UNION ALL SELECT {DAY}, {c}, 0, 1 FROM months_new)
                 GROUP BY {DAY}, {c})
         GROUP BY {DAY})"""
        for c in ("issued", "closing_stock")
    ),
    "months_old",
    "months_new",
)
ORACLES["t_closed"] = ORACLES["l_close"]
ORACLES["sql_reorders"] = ORACLES["m_reorder"]
ORACLES["sql_history"] = ORACLES["l_runhist"]
ORACLES["sql_status"] = ORACLES["l_fresh"]
ORACLES["t_refresh"] = ORACLES["m_stock"]
ORACLES["t_reorder"] = ORACLES["m_reorder"]
ORACLES["t_usage"] = ORACLES["m_usage"]
ORACLES["t_summary"] = query(
    " UNION ALL ".join(
        f"""SELECT {n} AS summary_id, (SELECT MAX(date) FROM ledger_b{n}) AS summary_date, 0 AS summary_hour,
       COUNT(DISTINCT organization) AS total_organizations, COUNT(DISTINCT item) AS total_items,
       COUNT(*) FILTER (risk_status = 'HIGH') AS high_risk_count, COUNT(*) FILTER (s.days_left <= 0) AS critical_risk_count,
       COALESCE(SUM(reorder_qty), 0e0) AS total_reorder_qty
  FROM stock_b{n} s LEFT JOIN advice_b{n} a USING ({KEY})"""
        for n in BATCHES
    ),
    *[f"advice_b{n}" for n in BATCHES],
)
ALL_ALERTS = " UNION ALL ".join(
    f"SELECT * EXCLUDE (risk_status), (SELECT MAX(date) FROM ledger_b{n}) AS alert_date FROM alerted_b{n}" for n in BATCHES
)
ORACLES["t_alert_log"] = query(ALL_ALERTS, *[f"alerted_b{n}" for n in BATCHES])
ORACLES["t_runs"] = query(
    f"""SELECT 'refresh_summary' AS task_name, 'SUCCESS' AS status, 4 AS runs, 4 AS records_processed
 UNION ALL SELECT 'generate_alerts', 'SUCCESS', 4, COUNT(*) FROM ({ALL_ALERTS})""",
    *[f"alerted_b{n}" for n in BATCHES],
)
ORACLES["t_retain_tables"] = query(
    "SELECT (SELECT MAX(date) FROM ledger) AS alert_date, COUNT(*) AS alerts FROM alerted_b3", "alerted_b3"
)
