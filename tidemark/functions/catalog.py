"""KPI catalogues and thresholds.

Fixed values: keys, labels, units, directions and thresholds are part of the result contract.
"""

from __future__ import annotations

from typing import NamedTuple


class Kpi(NamedTuple):
    key: str
    label: str
    unit: str
    better: str


# --- paid ads -------------------------------------------------------------------------------

ADS_KPIS = [
    Kpi("cost", "Spend", "currency", "context"),
    Kpi("impressions", "Impressions", "int", "context"),
    Kpi("clicks", "Clicks", "int", "higher"),
    Kpi("ctr", "CTR", "rate", "higher"),
    Kpi("average_cpc", "Avg. CPC", "currency", "lower"),
    Kpi("conversions", "Conversions", "decimal", "higher"),
    Kpi("conversion_rate", "Conversion rate", "rate", "higher"),
    Kpi("cost_per_conversion", "CPA", "currency", "lower"),
    Kpi("conversions_value", "Conversion value", "currency", "higher"),
    Kpi("roas", "ROAS", "decimal", "higher"),
    Kpi("search_impression_share", "Search impression share", "rate", "higher"),
    Kpi("search_lost_is_budget", "Search lost IS (budget)", "rate", "lower"),
    Kpi("search_lost_is_rank", "Search lost IS (rank)", "rate", "lower"),
]
# The ten metrics compared for every campaign.
CAMPAIGN_KPIS = ADS_KPIS[:10]
ADS_FLOORS = {"currency": 25.0, "int": 25.0, "rate": 0.5, "decimal": 0.1}
ADS_MATERIAL_PCT = 10.0
ADS_SMALL_CONVERSIONS = 30
ADS_SPARSE_CLICKS = 100

# --- web analytics --------------------------------------------------------------------------

WEB_KPIS = [
    Kpi("activeUsers", "Active Users", "int", "higher"),
    Kpi("totalUsers", "Total Users", "int", "higher"),
    Kpi("newUsers", "New Users", "int", "context"),
    Kpi("sessions", "Sessions", "int", "higher"),
    Kpi("engagedSessions", "Engaged Sessions", "int", "higher"),
    Kpi("engagementRate", "Engagement Rate", "rate", "higher"),
    Kpi("bounceRate", "Bounce Rate", "rate", "lower"),
    Kpi("averageSessionDuration", "Avg. Session Duration", "duration", "higher"),
    Kpi("screenPageViews", "Views", "int", "higher"),
    Kpi("screenPageViewsPerSession", "Views per Session", "decimal", "higher"),
    Kpi("sessionsPerUser", "Sessions per User", "decimal", "context"),
    Kpi("eventCount", "Event Count", "int", "context"),
    Kpi("eventsPerSession", "Events per Session", "decimal", "context"),
    Kpi("keyEvents", "Key Events", "decimal", "higher"),
    Kpi("sessionKeyEventRate", "Session Key Event Rate", "rate", "higher"),
    Kpi("userKeyEventRate", "User Key Event Rate", "rate", "higher"),
]
ECOMMERCE_KPIS = [
    Kpi("totalRevenue", "Total Revenue", "currency", "higher"),
    Kpi("purchaseRevenue", "Purchase Revenue", "currency", "higher"),
    Kpi("transactions", "Transactions", "int", "higher"),
    Kpi("ecommercePurchases", "Ecommerce Purchases", "int", "higher"),
    Kpi("totalPurchasers", "Purchasers", "int", "higher"),
    Kpi("firstTimePurchasers", "First-time Purchasers", "int", "higher"),
    Kpi("purchaserRate", "Purchaser Rate", "rate", "higher"),
    Kpi("averagePurchaseRevenue", "Avg. Purchase Revenue", "currency", "higher"),
    Kpi("averageRevenuePerUser", "Revenue per User", "currency", "higher"),
    Kpi("itemsViewed", "Items Viewed", "int", "context"),
    Kpi("addToCarts", "Add to Carts", "int", "higher"),
    Kpi("itemsAddedToCart", "Items Added to Cart", "int", "higher"),
    Kpi("checkouts", "Checkouts", "int", "higher"),
    Kpi("itemsCheckedOut", "Items Checked Out", "int", "higher"),
    Kpi("itemsPurchased", "Items Purchased", "int", "higher"),
    Kpi("cartToViewRate", "Cart-to-View Rate", "rate", "higher"),
    Kpi("purchaseToViewRate", "Purchase-to-View Rate", "rate", "higher"),
]
WEB_FLOORS = {"int": 50.0, "decimal": 5.0, "rate": 1.0, "currency": 100.0, "duration": 5.0}
WEB_MATERIAL_PCT = 10.0
WEB_MIN_SESSIONS = 100
WEB_MIN_KEY_EVENTS = 15
WEB_SPIKE_Z = 3.5

# Metrics delivered as fractions and shown in percentage points.
WEB_RATE_METRICS = [
    "engagementRate", "bounceRate", "sessionKeyEventRate", "userKeyEventRate",
    "sessionConversionRate", "userConversionRate", "purchaserRate", "cartToViewRate",
    "purchaseToViewRate",
]
# Older metric names and the names used for them everywhere else.
WEB_CANONICAL = {
    "conversions": "keyEvents",
    "sessionConversionRate": "sessionKeyEventRate",
    "userConversionRate": "userKeyEventRate",
}
KEY_EVENT_METRICS = ["keyEvents", "sessionKeyEventRate", "userKeyEventRate"]
LEGACY_KEY_EVENT_METRICS = ["conversions", "sessionConversionRate", "userConversionRate"]
ECOMMERCE_SIGNALS = ["transactions", "ecommercePurchases", "purchaseRevenue", "totalRevenue"]

# Dimension names by role, most recent name first.
DIMENSION_ALIASES = {
    "landing_page": ["landingPagePlusQueryString", "landingPage"],
    "session_channel": ["sessionDefaultChannelGroup", "sessionDefaultChannelGrouping"],
    "first_user_channel": ["firstUserDefaultChannelGroup", "firstUserDefaultChannelGrouping"],
    "session_source_medium": ["sessionSourceMedium"],
    "session_campaign": ["sessionCampaignName", "sessionCampaignId"],
    "first_user_source_medium": ["firstUserSourceMedium"],
    "page_path": ["pagePath"],
    "page_title": ["pageTitle"],
    "hostname": ["hostName"],
    "device": ["deviceCategory"],
    "browser": ["browser"],
    "os": ["operatingSystem"],
    "platform": ["platform"],
    "country": ["country"],
    "region": ["region"],
    "city": ["city"],
    "event_name": ["eventName"],
    "item_name": ["itemName"],
    "date": ["date"],
}

# Rows kept per breakdown and the metric they are ranked by.
WEB_CAPS = {
    "channels": (50, "sessions"),
    "source_medium": (50, "sessions"),
    "campaigns": (50, "sessions"),
    "first_user_channels": (50, "totalUsers"),
    "landing_pages": (100, "sessions"),
    "pages": (100, "screenPageViews"),
    "hostname": (20, "sessions"),
    "devices": (10, "sessions"),
    "browsers": (15, "sessions"),
    "operating_systems": (15, "sessions"),
    "platforms": (10, "sessions"),
    "geo_country": (30, "sessions"),
    "geo_region": (30, "sessions"),
    "geo_city": (30, "sessions"),
    "events": (100, "eventCount"),
    "items": (25, "itemsPurchased"),
    "revenue_by_channel": (50, "totalRevenue"),
    "revenue_by_device": (10, "totalRevenue"),
}

SEGMENT_CSV_METRICS = [
    "sessions", "totalUsers", "newUsers", "engagedSessions", "engagementRate",
    "averageSessionDuration", "screenPageViews", "keyEvents", "sessionKeyEventRate",
    "totalRevenue", "transactions",
]
# Events collected without any set-up; they carry no business meaning of their own.
AUTOMATIC_EVENTS = [
    "page_view", "session_start", "first_visit", "user_engagement", "scroll", "click",
    "view_search_results", "file_download", "video_start", "video_progress", "video_complete",
    "form_start", "form_submit",
]
FUNNEL_STEPS = [
    ("itemsViewed", "Items viewed"),
    ("itemsAddedToCart", "Items added to cart"),
    ("itemsCheckedOut", "Items checked out"),
    ("itemsPurchased", "Items purchased"),
]
UNATTRIBUTED_LABELS = ["(not set)", "(other)", "(not provided)", ""]

# --- organic search -------------------------------------------------------------------------

SEARCH_KPIS = [
    Kpi("clicks", "Clicks", "int", "higher"),
    Kpi("impressions", "Impressions", "int", "higher"),
    Kpi("ctr", "CTR", "rate", "higher"),
    Kpi("average_position", "Average position", "position", "lower"),
]
SEARCH_FLOORS = {"clicks": 10.0, "impressions": 100.0, "ctr": 0.2, "average_position": 0.3}
SEARCH_MATERIAL_PCT = 5.0
SEARCH_SMALL_CLICKS = 30
SEARCH_SMALL_IMPRESSIONS = 1000
OPPORTUNITY_SHARE = 0.0005
OPPORTUNITY_FLOOR = 100
TOP_N = 15
DETAIL_N = 10
# Upper bounds (exclusive) of the position bands; the last band is open.
POSITION_BANDS = [("1-3", 3.5), ("4-10", 10.5), ("11-20", 20.5), ("21+", 1e9)]
BENCHMARK_MIN_ROWS = 8
BENCHMARK_MIN_IMPRESSIONS = 10
CANNIBAL_MIN_IMPRESSIONS = 200
CANNIBAL_MIN_SHARE = 0.2
FRESHNESS_LOOKBACK_DAYS = 14
RETENTION_DAYS = 480

# --- headline tiles -------------------------------------------------------------------------

HEADLINES = {
    "ads": ["cost", "conversions", "cost_per_conversion", "roas", "clicks", "conversion_rate"],
    "web": ["sessions", "activeUsers", "engagementRate", "keyEvents", "engagedSessions",
            "averageSessionDuration"],
    "search": ["clicks", "impressions", "ctr", "average_position"],
}

# --- ledger ---------------------------------------------------------------------------------

LEDGER_COLUMNS = [
    "merchant", "purchase_date", "currency", "gross_amount", "tax_amount", "net_amount",
    "receipt_number", "category", "confidence", "needs_review", "review_notes", "file_path",
    "processed_at",
]
NET_TOLERANCE = "0.011"
REVIEW_CONFIDENCE = "0.70"
DIRECTLY_READABLE = ["jpg", "jpeg", "png", "gif"]
NEEDS_CONVERSION = ["heic", "heif", "webp", "tif", "tiff", "bmp"]
RUN_ARTEFACTS = ["needs-review.md", "receipts-notified.log"]
LEGAL_SUFFIXES = ["ltd", "limited", "plc", "inc", "llc", "gmbh"]
# Review reasons an approved vendor settles; every other reason stands.
CLEARABLE_REASONS = ["personal_spending", "tax_without_number", "round_total_no_items"]

CURRENCY_SYMBOLS = {
    "USD": "$", "GBP": "£", "EUR": "€", "CAD": "C$", "AUD": "A$", "NZD": "NZ$", "JPY": "¥",
    "INR": "₹", "ZAR": "R", "SEK": "kr", "CHF": "CHF ", "BRL": "R$", "MXN": "MX$",
}
LEDGER_SYMBOLS = {"GBP": "£", "USD": "$", "EUR": "€", "JPY": "¥", "CAD": "CA$", "AUD": "A$"}
