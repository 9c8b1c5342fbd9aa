"""Fixed values that must equal the shop's own texts and settings.

They are stated here as plain text, in the shop's order, and used by both the
Spark operators and the DuckDB oracle text.
"""

# --- fixed values: response and message texts -------------------------------
ORDER_PLACED_TEXT = "Order Placed Successfully"
OUT_OF_STOCK_PREFIX = "Product with Skucode "
OUT_OF_STOCK_SUFFIX = "is out of stock"
SERVER_ERROR_TEXT = "Internal Server Error"
SERVICE_UNAVAILABLE_TEXT = "Service Unavailable, please try again later"
SUBJECT_PREFIX = "\U0001F389 Order Confirmed | "
EVENT_TOPIC = "order-placed"

# --- fixed values: HTML entities, applied with "&" first ---------------------
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                 ('"', "&quot;"), ("'", "&#39;")]

# --- fixed values: gateway routes (route id, path, method or None, target) ---
ROUTES = [
    ("product_service", "/api/product", None, "http://localhost:8080"),
    ("product_service_swagger", "/aggregate/product-service/v3/api-docs", None, "http://localhost:8080"),
    ("order_service", "/api/order", None, "http://localhost:8081"),
    ("order_service_swagger", "/aggregate/order-service/v3/api-docs", None, "http://localhost:8081"),
    ("inventory_service", "/api/inventory", None, "http://localhost:8082"),
    ("inventory_service_swagger", "/aggregate/inventory-service/v3/api-docs", None, "http://localhost:8082"),
    ("fallbackRoute", "/fallbackRoute", "GET", None),
]
DOCS_PATH = "/api-docs"
SWAGGER_ROUTE_SUFFIX = "_swagger"

# --- scrape targets (keys of our own) and their application label --------------
TARGETS = [
    ("svc-0", "Api Gateway"),
    ("svc-1", "Product Service"),
    ("svc-2", "Order Service"),
    ("svc-3", "Inventory Service"),
    ("svc-4", "Notification Service"),
]
SCRAPE_INTERVAL = "2 seconds"

# --- fixed values: resilience settings ----------------------------------------
CALL_TIME_LIMIT_S = 3.0
INVENTORY_WINDOW = 5           # inventory client: last 5 calls
GATEWAY_WINDOW = 10            # gateway default: last 10 calls
MIN_CALLS = 5
FAILURE_RATE_THRESHOLD = 0.5
TRACE_SAMPLING_PROBABILITY = 1.0

# --- fixed values: log levels, lowest first; records at INFO and above are kept
LOG_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR"]
MIN_LOG_LEVEL = "INFO"

# --- console log line: time [thread] logger [traceId,spanId] - message ---------
LOG_LINE_PATTERN = r"^(\S+ \S+) \[([^\]]*)\] (\S+) \[([^,\]]*),([^\]]*)\] - (.*)$"
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# The trace id alone, for jobs that need nothing else of a line.
LOG_TRACE_ID_PATTERN = r"^\S+ \S+ \[[^\]]*\] \S+ \[([^,\]]*),"
# --- fixed values: trace id matcher of the log store's derived field ------------
TRACE_ID_MATCHER = r"\[.+,(.+?),"

# --- fixed values: application names of the five services ---------------------
APPLICATIONS = ["api-gateway", "product-service", "order-service",
                "inventory-service", "notification-service"]
