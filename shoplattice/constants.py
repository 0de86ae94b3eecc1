"""Fixed domain values.

These must equal the published behaviour for results to agree, so they are
stated plainly here and imported everywhere else.
"""

# Order and event vocabularies -------------------------------
REVENUE_STATUSES = ("paid", "shipped", "delivered")
ORDER_STATUSES = ("pending", "paid", "shipped", "delivered", "cancelled", "returned")
EVENT_TYPES = (
    "product_view", "search", "click", "add_to_cart",
    "remove_from_cart", "wishlist", "purchase", "review",
)
EVENT_WEIGHTS = {
    "product_view": 1.0, "click": 1.5, "wishlist": 3.0, "add_to_cart": 4.0,
    "remove_from_cart": -1.0, "purchase": 6.0, "review": 3.0, "search": 0.0,
}
VIEW_TYPES = ("product_view", "click")
TRENDING_TYPES = ("product_view", "add_to_cart", "purchase")

# Ranking weights --------------------------------------------
SEARCH_WEIGHTS = {
    "text": 0.30, "semantic": 0.25, "popularity": 0.12, "rating": 0.10,
    "conversion": 0.10, "personal": 0.08, "availability": 0.05,
}
SEARCH_SIGNAL_LABELS = {
    "text": "keyword match", "semantic": "semantic similarity", "popularity": "popularity",
    "rating": "customer rating", "conversion": "conversion rate",
    "personal": "your preferences", "availability": "availability",
}
RECOMMENDER_WEIGHTS = {
    "collaborative": 0.35, "content": 0.25, "popularity": 0.15,
    "personalization": 0.15, "business": 0.10,
}
RECOMMENDER_REASONS = {
    "collaborative": "customers with similar taste bought this",
    "content": "it is similar to items you viewed",
    "popularity": "it is trending across the store",
    "personalization": "it matches your preferred categories and brands",
    "business": "it is well stocked and highly rated",
}

# Half-lives, thresholds, windows ----------------------------
PROFILE_HALF_LIFE_DAYS = 45.0
INTERACTION_DECAY_DAYS = 180.0
DRIFT_THRESHOLD = 0.2
PRICE_TREND_THRESHOLD = 0.04
CLICK_WINDOW_HOURS = 6
CONVERSION_WINDOW_HOURS = 48
CANDIDATE_POOL = 300
BM25_K1, BM25_B = 1.5, 0.75

# Text vocabularies ------------------------------------------
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is",
    "it", "its", "of", "on", "or", "that", "the", "to", "with", "your", "you", "this", "these", "those",
)
NEGATION_TERMS = (
    "not ", "no ", "never", "isn't", "wasn't", "doesn't", "didn't", "don't", "hardly", "barely",
    "lacks", "lacking", "without",
)
CLAUSE_BREAK = r"[.!?;,]+|\bbut\b|\bhowever\b|\balthough\b|\bthough\b|\band yet\b"
CHEAP_WORDS = ("cheap", "budget", "affordable", "inexpensive")
PREMIUM_WORDS = ("premium", "best", "professional", "pro ")
IN_STOCK_WORDS = ("in stock", "available")

# Aspect lexicon (keywords, positive phrases, negative phrases)
ASPECT_LEXICON = {
    "battery_life": (
        ("battery", "charge", "charging", "runtime", "power"),
        ("battery life is excellent and easily lasts a full week",
         "it holds a charge far longer than I expected",
         "the runtime between charges is outstanding"),
        ("the battery drains much faster than advertised",
         "it needs charging almost every single day",
         "runtime is disappointing and charging is slow"),
    ),
    "sound_quality": (
        ("sound", "audio", "bass", "treble", "noise"),
        ("the sound is crisp with genuinely deep bass",
         "audio clarity is superb across the whole range",
         "noise isolation is better than anything at this price"),
        ("the sound is muddy and the bass is overpowering",
         "audio quality is thin and tinny at higher volume",
         "there is a persistent hiss in quiet passages"),
    ),
    "comfort": (
        ("comfort", "comfortable", "fit", "cushion", "ergonomic", "wear"),
        ("it stays comfortable even after several hours",
         "the fit is snug without any pressure points",
         "the cushions are soft and breathable"),
        ("the ear cushions are uncomfortable after twenty minutes",
         "the fit is far too tight and starts to ache",
         "it becomes hot and sweaty during long sessions"),
    ),
    "build_quality": (
        ("build", "quality", "material", "construction", "solid", "flimsy"),
        ("the build quality feels premium and solid",
         "materials are clearly a step above the competition",
         "construction is tight with no creaking anywhere"),
        ("the plastic feels flimsy and creaks constantly",
         "build quality is poor for the price point",
         "a hinge cracked within the first month"),
    ),
    "value": (
        ("price", "value", "money", "cheap", "expensive", "worth"),
        ("outstanding value for what you pay",
         "hard to beat at this price",
         "worth every penny and then some"),
        ("seriously overpriced for what you actually get",
         "not worth the money compared to alternatives",
         "the price is hard to justify"),
    ),
    "shipping": (
        ("shipping", "delivery", "arrived", "packaging", "package"),
        ("arrived two days early and beautifully packaged",
         "delivery was quick and the packaging was secure"),
        ("the package arrived crushed and late",
         "shipping took over three weeks with no updates"),
    ),
    "durability": (
        ("durable", "durability", "broke", "lasted", "wear", "scratch"),
        ("still looks new after months of heavy use",
         "it has survived daily abuse without a scratch"),
        ("it stopped working after just six weeks",
         "scratches appeared almost immediately"),
    ),
    "ease_of_use": (
        ("setup", "easy", "intuitive", "instructions", "app", "confusing"),
        ("setup took under five minutes and was completely intuitive",
         "the app is clean and genuinely easy to navigate"),
        ("setup was confusing and the instructions were useless",
         "the companion app is buggy and crashes often"),
    ),
    "design": (
        ("design", "look", "style", "colour", "aesthetic", "sleek"),
        ("the design is sleek and looks great on a desk",
         "genuinely attractive - it gets compliments"),
        ("it looks far cheaper in person than in the photos",
         "the styling is dated and the colour is off"),
    ),
    "performance": (
        ("performance", "fast", "slow", "lag", "speed", "responsive"),
        ("performance is fast and completely lag free",
         "it handles heavy workloads without breaking a sweat"),
        ("performance is sluggish and it stutters under load",
         "noticeable lag makes it frustrating to use"),
    ),
}
LEXICON_FRAGMENT = 28

# Models ------------------------------------------------------
MODEL_NAMES = ("recommendation", "sentiment", "forecasting", "price_prediction", "segmentation")
FORECAST_LAGS = (1, 2, 3, 4, 8, 12)
FORECAST_WINDOWS = (4, 8, 12)
FORECAST_HORIZONS = (7, 14, 30)
FORECAST_MIN_WEEKS, FORECAST_MIN_UNITS, FORECAST_HOLDOUT_WEEKS = 20, 25, 8
SEGMENT_FEATURES = (
    "recency_days", "frequency", "monetary", "avg_order_value", "product_diversity",
    "session_frequency", "discount_affinity", "tenure_days", "review_count",
)
# For each segment name, in order of choice, the weight of every feature's rank; a negative weight counts the
# rank from above.
SEGMENT_RULES = (
    ("high_value", {"monetary": 0.5, "avg_order_value": 0.3, "recency_days": -0.2}),
    ("at_risk", {"recency_days": 0.6, "tenure_days": 0.25, "frequency": -0.15}),
    ("new_customer", {"tenure_days": -0.7, "frequency": -0.3}),
    ("loyal_customer", {"frequency": 0.4, "tenure_days": 0.3, "recency_days": -0.3}),
    ("discount_seeker", {"discount_affinity": 0.75, "frequency": 0.25}),
    ("frequent_buyer", {"frequency": 0.55, "product_diversity": 0.45}),
    ("occasional_buyer", {"frequency": -0.5, "monetary": -0.5}),
)
SEGMENT_REST = "occasional_buyer"
SEGMENT_CANDIDATE_K = (4, 5, 6, 7, 8)
SILHOUETTE_TOLERANCE = 0.88
PRICE_FEATURES = (
    "brand_reputation", "rating_avg", "rating_count", "inventory", "discount_pct",
    "units_sold_90d", "revenue_90d", "sales_velocity", "views_90d", "conversion_rate",
    "category_mean_price_loo", "category_p25_price", "category_p75_price", "days_since_launch",
    "spec_weight_g", "warranty_months", "description_length", "tag_count",
)

# Grid of the recommender's weights ----------------------------
GRID_SHARES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0)
GRID_BUSINESS = (0.0, 0.02, 0.05, 0.1)
GRID_MARGIN = 1.002
