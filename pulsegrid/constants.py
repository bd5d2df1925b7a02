"""Fixed values the results depend on: names, labels, thresholds and text patterns.

They are stated here, together, so that callers can see and override them.
"""

from __future__ import annotations

# --- time -------------------------------------------------------------------
DEFAULT_TZ = "America/New_York"
DOW_SUNDAY_FIRST = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
DOW_MONDAY_FIRST = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# --- users ------------------------------------------------------------------
SYSTEM_WALLETS = ["server", "unknown", "system", ""]
SERVER_PLATFORM = "server"
APP_PLATFORMS = ["ios", "android"]
LOGIN_BADGES = {
    "google": "Google",
    "email": "Email",
    "apple": "Apple",
    "twitter": "Twitter",
    "phone": "Phone",
    "wallet_only": "Wallet",
}
NO_LOGIN_BADGE = "—"
UNKNOWN_LABEL = "?"

# --- events -----------------------------------------------------------------
SESSION_START = "session_start"
SESSION_END = "session_end"
NOTIFICATION_RECEIVED = "notification_received"
NOTIFICATION_TAP = "notification_tap"
NOTIFICATION_SENT = "notification_sent"
NOTIFICATION_BROADCAST = "notification_sent_broadcast"
TRADE_INITIATED = "trade_initiated"

FUNNEL_NOTIFICATION_TRADE = [
    ("Notif Received", "notification_received"),
    ("Notif Tapped", "notification_tap"),
    ("Trade Started", "trade_initiated"),
    ("Trade Success", "trade_success"),
]
FUNNEL_TRADE = [
    ("Buy Tap", "buy_button_tap"),
    ("Swap Modal", "swap_modal_open"),
    ("Trade Started", "trade_initiated"),
    ("Trade Success", "trade_success"),
    ("Trade Error", "trade_error"),
]
FUNNEL_DEPOSIT = [
    ("Modal Open", "deposit_modal_open"),
    ("Initiated", "deposit_initiated"),
    ("Success", "deposit_success"),
    ("Error", "deposit_error"),
]
DEPOSIT_EVENTS = ["deposit_initiated", "deposit_success", "deposit_error"]
ENGAGEMENT_EVENTS = [
    "feed_card_tap", "token_detail_view", "search_query", "category_select",
    "chart_period_change", "scroll_depth", "side_drawer_open",
    "perps_order_placed", "bridge_transfer", "app_open_deep_link",
]
RETENTION_DAYS = [0, 1, 3, 7, 14, 30]
BROADCAST_LABEL = "Trade Alerts (broadcast)"
TARGETED_LABELS = {"price_alert": "Price Alert", "lifecycle": "Lifecycle"}

# --- trades -----------------------------------------------------------------
SWAP, PERPS, DEPOSIT = "swap", "perps", "deposit"
NOTIONAL_VENUE = "ostium"  # this venue already reports notional amounts in USD

# --- metrics ----------------------------------------------------------------
BACKEND_ENVIRONMENT = "development"
ORDER_VENUES = ["hyperliquid", "ostium"]
READ_VENUES = ["hyperliquid", "lighter", "ostium"]
WS_CAPACITY = 6 * 3500
ETH_BALANCE_ALARM = 0.005
SOL_BALANCE_ALARM = 0.5
ERROR_RATE_ALARM_PCT = 1.0
CDN_4XX_ALARM_PCT = 1.0
CDN_5XX_ALARM_PCT = 0.5
MEMORY_WARNING_PCT = 70.0
MEMORY_CRITICAL_PCT = 85.0
MIN_HEALTH_POINTS = 3
CDN_REGION = "Global"

METRIC_FEE_BALANCE = "Gas.FeePayerBalanceETH"
METRIC_API_REQUEST = "API.Request"
METRIC_API_ERROR = "API.Error"
METRIC_API_LATENCY = "API.Latency"
METRIC_ORDER_PLACE = "Order.PlaceLatency"
METRIC_ORDER_CANCEL = "Order.CancelLatency"
METRIC_WITHDRAW = "Withdraw.Latency"
METRIC_BRIDGE_SUCCESS = "Bridge.Success"
METRIC_BRIDGE_FAILURE = "Bridge.Failure"
METRIC_BRIDGE_DURATION = "Bridge.TotalDuration"
METRIC_BRIDGE_FILL = "Bridge.FillTime"
METRIC_ROUTE = "FundRouter.RouteLatency"
METRIC_REVERSE_ROUTE = "FundRouter.ReverseRouteLatency"
METRIC_SETTLE_TIMEOUT = "FundRouter.SettlementTimeout"
METRIC_VENUE_READ = "Venue.ReadLatency"
METRIC_VENUE_ERROR = "Venue.ReadError"
METRIC_CACHE_HIT = "Cache.Hit"
METRIC_CACHE_MISS = "Cache.Miss"
METRIC_WS_CONNECTIONS = "WS.ActiveConnections"
METRIC_WS_SENT = "WS.MessageSent"
METRIC_WS_RECEIVED = "WS.MessageReceived"
METRIC_WS_SLOW = "WS.SlowClientTerminated"
METRIC_SIGNING = "Privy.SigningLatency"
METRIC_SNAPSHOT = "Account.SnapshotLatency"
METRIC_MEMORY = "render.service.memory.usage"
METRIC_MEMORY_LIMIT = "render.service.memory.limit"
METRIC_CPU = "render.service.cpu.time"
METRIC_HTTP_REQUESTS = "render.service.http.requests.total"
METRIC_HTTP_LATENCY = "render.service.http.requests.latency"
METRIC_NETWORK_TX = "render.service.network.transmit.bytes"
METRIC_CDN_REQUESTS = "Requests"
METRIC_CDN_BYTES = "BytesDownloaded"
METRIC_CDN_4XX = "4xxErrorRate"
METRIC_CDN_5XX = "5xxErrorRate"
METRIC_CDN_HIT_RATE = "CacheHitRate"

DIM_ENVIRONMENT = "Environment"
DIM_VENUE = "Venue"
DIM_SERVICE = "service.name"
DIM_DISTRIBUTION = "DistributionId"
DIM_REGION = "Region"

# --- logs -------------------------------------------------------------------
ERROR_PRIORITY = 4
HTTP_MARK = "http-request"
SWAP_SERVICE_MARK = "swap-server"
SCRAPER_SERVICE_MARK = "twitter-scraper"
SIGNAL_MARK = "SIGNAL:"
UNSTRUCTURED = "(unstructured)"
DETAIL_LIMIT = 120

PRIORITY_PATTERN = r"^<(\d+)>"
SERVICE_PATTERN = r"^<\d+>\d+ \S+ (\S+)"
LOG_TIME_PATTERN = r"^<\d+>\d+ (\S+)"
LINE_PATTERN = r"^<\d+>\d+ (\S+) \S+ \S+ \d+ \S+ - (.*)"
STATUS_PATTERN = r'"statusCode":(\d+)'
PATH_PATTERN = r'"path":"([^"]+)"'
TIME_PATTERN = r'"time":"([^"]+)"'
METHOD_PATTERN = r'"method":"([^"]+)"'
LATENCY_PATTERN = r'"responseTimeMS":(\d+)'
ENDPOINT_PATTERN = r"^/([^?]+)"
IN_MINT_PATTERN = r"inputMint=([^&]+)"
OUT_MINT_PATTERN = r"outputMint=([^&]+)"
OUTCOME_PATTERN = r">>> (\S+)"
SIGNAL_PATTERN = r">>> SIGNAL: (\S+) (\S+)"
KEYWORD_PATTERN = r"(?i)(error|exception|fatal|crash|ECONNREFUSED)"
LEVEL_PATTERNS = {
    "errors only": r"(?i)(error|exception|fatal|panic|crash|ECONNREFUSED|ETIMEDOUT)",
    "warnings+": r"(?i)(error|warn|exception|fatal|panic|crash|timeout|fail)",
}
OUTCOME_LABELS = {
    "SIGNAL:": "Signals Generated",
    "Not": "Rejected (Not Tradable)",
    "Written": "Written to DB/Sheet",
}
