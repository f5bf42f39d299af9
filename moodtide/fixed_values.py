"""Values that decide results. They are fixed: changing one changes answers."""

# --- fixed values: process states of a post, in order -----------------------
STATUS_RAW = 0
STATUS_CLEANED = 1
STATUS_SCORED = 2

# --- fixed values: what a newly landed post is stamped with -----------------
SOURCE_PLATFORM = "eastmoney_guba"
TOPIC = "股吧"
UNKNOWN_AUTHOR = "unknown"

# --- fixed values: text cleaning, applied in this order ---------------------
# (pattern, replacement)
CLEANING_STEPS = [
    ("<[^>]+>", ""),
    ("https?://[^\\s]+", ""),
    ("\\$[^$]+\\$", ""),
    ("[\\r\\n\\t]+", " "),
    ("[ ]{2,}", " "),
]
CLEAN_CONTENT_CHARS = 1000

# --- fixed values: white space, as the inside of a character class ----------
# Java's \\s knows the ASCII ones only
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# --- fixed values: post ids --------------------------------------------------
POST_ID_MIN_DIGITS = 8
POST_ID_MAX_DIGITS = 11

# --- fixed values: time found in the visible text of a list row -------------
VISIBLE_TIME_PATTERN = (
    "(\\d{4}[-/]\\d{2}[-/]\\d{2}\\s+\\d{2}:\\d{2}(?::\\d{2})?"
    "|\\d{2}[-/]\\d{2}\\s+\\d{2}:\\d{2})"
)

# --- fixed values: what marks posts, authors and times on a list page -------
POST_ID_ATTRIBUTE = "data-postid"
OLD_ROW_CLASS = "articleh"
OLD_LINK_PART = "/news,"
AUTHOR_CLASSES = ["l4", "author", "uname"]
TIME_CLASSES = ["l5", "update"]
TIME_CLASS_PART = "time"
ROW_SEARCH_LEVELS = 5

# --- fixed values: keys of the JSON inside a page's scripts -----------------
SCRIPT_ID_KEY = "post_id"
SCRIPT_SOURCE_ID_KEY = "source_post_id"
SCRIPT_TIME_KEY = "post_publish_time"

# --- fixed values: names of where a post time was found ---------------------
TIME_FROM_SCRIPT = "script_json"
TIME_FROM_TAG = "dom_time_tag"
TIME_FROM_TEXT = "container_text_regex"
TIME_NOT_FOUND = "not_found"

# --- fixed values: sentiment labels and the words that name them ------------
LABEL_POSITIVE = "乐观"
LABEL_NEUTRAL = "中立"
LABEL_NEGATIVE = "悲观"
POSITIVE_WORDS = ["positive", "bullish", "optimistic", "乐观", "积极", "pos"]
NEUTRAL_WORDS = ["neutral", "中立", "中性", "neu"]
NEGATIVE_WORDS = ["negative", "bearish", "pessimistic", "悲观", "消极", "neg"]

# --- fixed values: risk levels and thresholds -------------------------------
LEVEL_LOW = "保守型"
LEVEL_MID = "稳健型"
LEVEL_HIGH = "激进型"
RISK_LEVELS = [LEVEL_LOW, LEVEL_MID, LEVEL_HIGH]
HIGH_FROM = 0.52
MID_FROM = 0.45
STEP_DOWN_ABOVE = 0.25
MIN_POSTS = 2

# --- fixed values: product score weights and reason thresholds --------------
YIELD_WEIGHT = 0.4
SHARPE_SCALE = 10
SHARPE_WEIGHT = 0.3
DRAWDOWN_WEIGHT = 1.2
TOP_PRODUCTS = 3
REASON_VOLATILITY_FROM = 0.20
REASON_SENTIMENT_FROM = 0.60
REASON_YIELD_FROM = 12

# --- fixed values: retention, history and trend sizes -----------------------
RETENTION_DAYS = 15
HISTORY_ROWS = 10
TREND_HOURS = 24
TREND_DIGITS = 4
EMPTY_GLOBAL_SCORE = 0.5
FILL_STRATEGY = "linear_interpolation_with_global_edge_anchors"
POINT_REAL = "real"
POINT_INTERPOLATED = "interpolated"
POINT_ANCHOR = "anchor"
HISTORY_TIME_FORMAT = "MM-dd HH:mm:ss"
HOUR_LABEL_FORMAT = "HH:'00'"
