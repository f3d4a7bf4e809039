"""Dictionaries and thresholds. Everything here is a default; every operator
takes its dictionary as a parameter.

The word lists, weights, names and cut-offs below are FIXED VALUES: results
are only right if they are exactly these.
"""

# --- fixed values -----------------------------------------------------------

EVENT_TYPES = ("BROKER_CALL", "FUND_FLOW", "MACRO", "PRICE_ACTION", "GLOBAL")
SENTIMENTS = ("POSITIVE", "NEGATIVE", "NEUTRAL")
HORIZONS = ("INTRADAY", "SHORT_TERM", "LONG_TERM")
SUGGESTIONS = ("BUY", "SELL", "HOLD", "WATCH")
LEVELS = ("HIGH", "MEDIUM", "LOW")

BROKER_KEYWORDS = (
    "securities", "broker", "broking", "icici", "motilal",
    "kotak", "axis", "jefferies", "goldman", "jp morgan",
    "upgrade", "downgrade", "target price", "rating",
)
MACRO_KEYWORDS = ("inflation", "rbi", "rate", "gdp", "rupee", "crude")
FUND_KEYWORDS = ("fii", "dii", "mutual fund", "fund flow")
GLOBAL_KEYWORDS = ("global", "nasdaq", "dow", "fed", "china", "us market")

POSITIVE_WORDS = ("gain", "rally", "surge", "upgrade", "beats", "strong", "buy", "record")
NEGATIVE_WORDS = ("fall", "crash", "loss", "downgrade", "weak", "sell", "probe", "decline")

STRONG_WORDS = (
    "record", "surge", "crash", "upgrade", "downgrade", "beats", "misses",
    "order", "stake", "block deal", "insider", "rbi", "sebi", "result",
    "profit", "loss", "guidance", "target price", "inflow", "outflow",
)
WEAK_WORDS = ("may", "could", "likely", "expects", "plans", "proposal", "consider")

WATCHLIST = (
    "RELIANCE.NS", "TCS.NS", "HDFCBANK.NS", "INFY.NS", "ICICIBANK.NS",
    "SBIN.NS", "BHARTIARTL.NS", "ITC.NS", "LT.NS", "AXISBANK.NS",
    "KOTAKBANK.NS", "BAJFINANCE.NS", "MARUTI.NS", "TATAMOTORS.NS",
    "ADANIENT.NS", "ADANIPORTS.NS", "HINDUNILVR.NS", "SUNPHARMA.NS",
    "WIPRO.NS", "HCLTECH.NS",
)
MARKET_TICKER = "MARKET.NS"
INVALID_TICKERS = (
    "TICKER.NS", "MARKET.NS", "SEBI", "SEBI.NS", "INR", "SENSEX", "NIFTY",
    "SENSEX|NIFTY", "INDIA.NS", "NIFTY50.NS", "BANK.NS", "FINANCIALS.NS",
    "INFRA.NS", "BANKNIFTY.NS", "NIFTY.NS", "SENSEX.NS",
)
INDEX_TICKERS = {"NIFTY": "^NSEI", "SENSEX": "^BSESN", "BANKNIFTY": "^NSEBANK"}

FEEDS = {
    "Moneycontrol": "https://www.moneycontrol.com/rss/marketreports.xml",
    "EconomicTimes": "https://economictimes.indiatimes.com/rssfeedsdefault.cms",
    "LiveMint": "https://www.livemint.com/rss/markets",
    "BusinessStandard": "https://www.business-standard.com/rss/markets-106.rss",
    "NSEIndia": "https://www.nseindia.com/rss-feed",
}

# Scores in hundredths.
SOURCE_RELIABILITY = {
    "BusinessStandard": 84, "EconomicTimes": 82, "Moneycontrol": 80,
    "LiveMint": 78, "NSEIndia": 86,
}
SOURCE_DEFAULT = 72
EVENT_WEIGHT = {
    "BROKER_CALL": 78, "FUND_FLOW": 74, "MACRO": 68, "PRICE_ACTION": 70, "GLOBAL": 64,
}
EVENT_DEFAULT = 66
ACTION_WEIGHT = {"BUY": 100, "SELL": 100, "HOLD": 72, "WATCH": 62}
ACTION_DEFAULT = 62

# Age limit in hours, score in hundredths, wording; past the last: STALE.
FRESHNESS_BANDS = ((6, 94, "fresh"), (24, 84, "same day"), (72, 68, "recent"))
STALE = (46, "stale")
UNKNOWN_AGE = (58, "unknown age")

RULE_REASONING = "Rule-based fallback used because the LLM response was unavailable."
NO_REASONING = "No reasoning returned."
FEED_FAILED = "Feed request failed"

JACCARD_PERCENT = 82          # lexical match: overlap / union >= 0.82
VECTOR_DISTANCE = 0.18        # semantic match: squared L2 distance < 0.18
FEED_LIMIT = 250
ALERT_LIMIT = 50
ALERT_SCORE = 80
TOP_STOCKS = 8
QUEUE_SIZE = 6
QUOTE_LIST = 12
QUOTE_LIMIT = 16
SIGNAL_QUOTES = 4
ITEMS_PER_FEED = 30
MESSAGE_CHARS = 3900
REASONING_CHARS = 600

# The URL namespace of name-based UUIDs (RFC 4122, appendix C), as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# --- end of fixed values ----------------------------------------------------
