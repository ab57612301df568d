"""Fixed values the pipeline is configured with: limits, word lists, topics."""

from __future__ import annotations

# --- limits (fixed values) ---------------------------------------------------

TARGET_TOTAL = 500
INIT_QUOTA = 100
MIN_QUOTA = 20
MAX_QUOTA = 200
MAX_DONATION = 100
DOMAIN_CAP_RATIO = 0.10
LOW_YIELD_ADDS = 10
DUP_WINDOW_PAGES = 4
DUP_RATE_BAD = 0.60
ITEMS_PER_PAGE = 50
EMBEDDING_DIM = 384
SEARCH_OVERFETCH = 3
SNIPPET_CHARS = 500
MIN_CONTENT_CHARS = 10
MIN_DOMAIN_CHARS = 3
MAX_URL_CHARS = 2083
CONTENT_ID_CHARS = 40
TOP_PUBLISHERS = 5
TIMELINE_DAYS = 14

# --- query-string keys dropped by URL normalization (fixed values) -----------

TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "dclid", "msclkid", "twclid", "yclid",
    "igshid", "_hsmi", "_hsenc", "mc_cid", "mc_eid", "vero_conv", "vero_id",
    "ref", "ref_src", "campaign", "cmp", "cmpid", "mbid",
)

# --- word lists (fixed values) -----------------------------------------------

TRANSFER_TERMS = (
    "transfer", "transfers", "signing", "signings", "loan", "loans", "bid",
    "bids", "deal", "deals", "medical", "window", "contract", "release clause",
)

TREND_TERMS = (
    "trend", "trends", "trending", "form", "streak", "standings", "table",
    "title race", "relegation", "momentum", "surge", "slump", "run", "race",
)

FOOTBALL_TERMS = (
    "football", "soccer", "premier league", "serie a", "la liga", "arsenal",
    "chelsea", "liverpool", "manchester city", "manchester united",
    "tottenham", "newcastle", "juventus", "inter", "milan", "napoli", "roma",
    "lazio", "real madrid", "barcelona", "atletico madrid", "sevilla",
    "valencia",
)

# --- topics in visiting order (fixed values) ---------------------------------
# (bucket key, domain, label, search query, ((feed name, feed url), ...))

TOPICS = (
    (
        "finance", "finance", "Finance",
        '"stock market" OR "interest rates" OR "Federal Reserve" OR inflation '
        'OR "earnings report" OR "IPO" OR "hedge fund" OR "private equity"',
        (
            ("MarketWatch", "https://feeds.marketwatch.com/marketwatch/topstories/"),
            ("Seeking Alpha", "https://seekingalpha.com/market_currents.xml"),
            ("Google News Finance",
             "https://news.google.com/rss/search?q=stock+market+OR+inflation+OR+interest+rates+OR+earnings"
             "&hl=en-US&gl=US&ceid=US:en"),
            ("Google News Reuters Finance",
             "https://news.google.com/rss/search?q=reuters+finance+OR+bloomberg+markets+OR+financial+times"
             "&hl=en-US&gl=US&ceid=US:en"),
        ),
    ),
    (
        "technology", "technology", "Technology",
        '"artificial intelligence" OR "machine learning" OR "large language model" '
        'OR startup OR "venture capital" OR "open source" OR "cloud computing"',
        (
            ("TechCrunch", "https://techcrunch.com/feed/"),
            ("Hacker News", "https://hnrss.org/frontpage"),
            ("Wired", "https://www.wired.com/feed/rss"),
            ("Google News Technology",
             "https://news.google.com/rss/search?q=artificial+intelligence+OR+machine+learning+OR+startup+OR+cloud"
             "&hl=en-US&gl=US&ceid=US:en"),
        ),
    ),
    (
        "premier_league", "football", "Premier League",
        '"Premier League" OR EPL OR "English Premier League" OR Arsenal '
        'OR Chelsea OR Liverpool OR "Manchester City" OR "Manchester United" '
        "OR Tottenham OR Newcastle",
        (
            ("The Guardian Premier League", "https://www.theguardian.com/football/premierleague/rss"),
            ("Google News Premier League",
             "https://news.google.com/rss/search?q=%22Premier+League%22+OR+EPL&hl=en-US&gl=US&ceid=US:en"),
        ),
    ),
    (
        "serie_a", "football", "Serie A",
        '"Serie A" OR "Italian football" OR Juventus OR Inter OR Milan OR Napoli OR Roma OR Lazio',
        (
            ("The Guardian Serie A", "https://www.theguardian.com/football/serieafootball/rss"),
            ("Google News Serie A",
             "https://news.google.com/rss/search?q=%22Serie+A%22+OR+Juventus+OR+Inter+OR+Milan"
             "&hl=en-US&gl=US&ceid=US:en"),
        ),
    ),
    (
        "la_liga", "football", "La Liga",
        '"La Liga" OR "Spanish football" OR "Real Madrid" OR Barcelona '
        'OR "Atletico Madrid" OR Sevilla OR Valencia',
        (
            ("The Guardian La Liga", "https://www.theguardian.com/football/laligafootball/rss"),
            ("Google News La Liga",
             "https://news.google.com/rss/search?q=%22La+Liga%22+OR+%22Real+Madrid%22+OR+Barcelona"
             "&hl=en-US&gl=US&ceid=US:en"),
        ),
    ),
)

FOOTBALL_DOMAIN = "football"
LEAGUE_KEYS = tuple(t[0] for t in TOPICS if t[1] == FOOTBALL_DOMAIN)
