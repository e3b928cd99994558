"""Constants, domains and wording that results depend on."""

# Days of stock reported when a series has no usage.
NO_USAGE_DAYS = 9999.0

# Rolling frames, counted in ledger rows.
SHORT_FRAME_ROWS = 7
LONG_FRAME_ROWS = 30

# Urgency bounds as multiples of the lead time.
CRITICAL_LEAD_SHARE = 0.5
MEDIUM_LEAD_SHARE = 1.5
SAFETY_DAYS = 30

# Priority score weights.
SCORE_PER_LEAD_DAY = 2.0
SCORE_PER_USED_UNIT = 1.5
SCORE_PER_STOCK_UNIT = 0.5

# Trend bounds and demand bounds (percent).
TREND_UP = 1.1
TREND_DOWN = 0.9
HIGHLY_VARIABLE_PCT = 50
VARIABLE_PCT = 25

# Order planning.
DEFAULT_ORDER_DAYS = 30
DEFAULT_ORDER_MIN = 10
ORDER_QTY_MIN = 0
ORDER_QTY_MAX = 10000
COVERAGE_DAYS = (60, 90)
SAFE_LEAD_SHARE = 2
TOP_ACTIONS = 3
TOP_ALERTS = 5
PREVIEW_ROWS = 20
TOP_LIST = 10

# Alerts are raised at or below this many days of stock.
ALERT_DAYS = 3

# Retention in days.
KEEP_SUMMARIES_DAYS = 90
KEEP_ALERTS_DAYS = 180
KEEP_RUNS_DAYS = 30

# Minutes between refreshes; the shortest lag any table is allowed.
REFRESH_MINUTES = 5

# Minutes that each refreshed table may lag behind the ledger.
TABLE_LAGS = {"stock": 5, "recommendations": 10, "usage": 15}

# Tolerance of the result comparison.
PARITY_TOLERANCE = 0.01

# Domains.
SECTORS = ["Hospital", "NGO", "Government", "Private", "Other"]
OPEN_ORDER_STATES = ["PENDING", "CONFIRMED", "SHIPPED"]
DEFAULT_ACTION_PAGE = "Dashboard"

# Score bounds and the rules used when no rule file can be read.
RULE_SCORE_RANGE = (1, 15)
DEFAULT_SCORE_RANGE = (1, 10)
FALLBACK_RULES = {
    "location_rules": [{"pattern": "Emergency Unit", "score": 10}],
    "item_rules": [
        {"items": ["Paracetamol", "Insulin", "Syringes", "Bandages", "Masks", "Gloves"], "score": 7},
        {"items": ["Rice"], "score": 5},
    ],
    "default_score": 3,
}

# Sentence wording.
ALERT_SENTENCE = (
    "%s at %s – %s is at high risk of stock-out. "
    "Average daily usage is %s units with a supplier lead time of %s days. "
    "Current stock will last approximately %s days, "
    "which is insufficient to cover the lead time period."
)
ACTION_SENTENCE = (
    "Reorder %s at %s – %s. High daily usage and long supplier lead time "
    "make this the most urgent action."
)
