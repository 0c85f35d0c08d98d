"""The word lists, patterns and tables that decide results.

Everything in this file is data. Order matters where a rule says "first hit
wins", so the lists keep their natural order.
"""

# ---------------------------------------------------------------- urls
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp"]

CRAWL_MEDIA_EXTENSIONS = [".pdf", ".mp4", ".avi", ".zip", ".doc", ".docx", ".mp3", ".wav"]

SITE_MEDIA_EXTENSIONS = [".pdf", ".mp4", ".zip", ".doc", ".mp3", ".wav"]

LINK_SKIP_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp",
    ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mp3", ".wav",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar",
]

LINK_SKIP_PATHS = ["/feed/", "/rss/", "/wp-json/", "/xmlrpc.php", "/wp-login.php", "/wp-admin/"]

UPLOAD_DIR = "/wp-content/uploads/"

CRAWL_SKIP_PATTERNS = [
    ("/feed/", "rss_feed"),
    ("/rss/", "rss_feed"),
    ("/wp-json/", "api_endpoint"),
    ("/xmlrpc.php", "xml_rpc"),
    ("/wp-login.php", "login_page"),
    ("/wp-admin/", "admin_page"),
    ("/login", "login_page"),
    ("/signin", "login_page"),
    ("/sign-in", "login_page"),
    ("/cart/", "cart_page"),
    ("/basket", "cart_page"),
    ("/checkout/", "checkout_page"),
    ("/payment", "checkout_page"),
    ("/my-account/", "account_page"),
    ("/account", "account_page"),
    ("/profile", "account_page"),
    ("/customer-service/", "service_page"),
    ("/help", "service_page"),
    ("/support", "service_page"),
    ("/contact", "contact_page"),
    ("/about-us", "info_page"),
    ("/privacy-policy", "policy_page"),
    ("/privacy", "policy_page"),
    ("/terms-of-service", "policy_page"),
    ("/terms", "policy_page"),
    ("/conditions", "policy_page"),
    ("/returns", "policy_page"),
    ("/shipping", "policy_page"),
    ("/faq", "faq_page"),
    ("/sitemap", "sitemap"),
    ("/robots.txt", "robots"),
]

SITE_SKIP_PATTERNS = [
    ("/feed/", "rss_feed"),
    ("/rss/", "rss_feed"),
    ("/wp-json/", "api_endpoint"),
    ("/wp-login.php", "login_page"),
    ("/wp-admin/", "admin_page"),
    ("/login", "login_page"),
    ("/signin", "login_page"),
    ("/cart/", "cart_page"),
    ("/checkout/", "checkout_page"),
    ("/my-account/", "account_page"),
    ("/contact", "contact_page"),
    ("/contact-us", "contact_page"),
    ("contact.html", "contact_page"),
    ("/privacy", "policy_page"),
    ("/terms", "policy_page"),
    ("/returns", "policy_page"),
    ("/shipping", "policy_page"),
    ("facebook.com", "social_media"),
    ("twitter.com", "social_media"),
    ("instagram.com", "social_media"),
    ("linkedin.com", "social_media"),
    ("youtube.com", "social_media"),
    ("pinterest.com", "social_media"),
    ("tiktok.com", "social_media"),
]

ARCHIVE_PATTERNS = ["/tag/", "/category/", "/author/"]

PAGINATION_PATTERN = r"/page/\d+"
PAGINATION_QUERY = "?page="

FETCH_BLOCKLIST = [
    "/login", "/signin", "/sign-in",
    "/cart", "/basket",
    "/account", "/my-account", "/profile",
    "/checkout", "/payment",
    "/privacy", "/terms", "/conditions",
    "/faq", "/help", "/support",
    "/contact", "/about-us",
    "/sitemap", "/robots.txt",
]

# ---------------------------------------------------------------- site profiling
PRODUCT_LINK_WORDS = ["product", "item", "shop", "catalog", "store", "buy", "model"]
PROJECT_LINK_WORDS = ["project", "case-study", "portfolio", "work", "gallery", "showcase"]
BLOG_LINK_WORDS = ["blog", "news", "article", "post", "story"]

SCRIPT_APP_MARKERS = [
    "react", "vue", "angular", "next.js", "nuxt",
    "data-react", "ng-app", "v-app", "__NEXT_DATA__",
]
FORM_MARKERS = ["<form", "<input", "<select", "<button"]

SITE_KEYWORDS = [
    "configure", "build", "custom", "customize", "design",
    "project", "portfolio", "case study", "work",
    "product", "catalog", "shop", "store",
    "service", "solution", "offering",
]

SITE_CATEGORY_TERMS = [
    ("e-commerce", ["add to cart", "shopping cart", "checkout", "buy now", "add to bag"]),
    ("configurator", ["configure", "build your", "customize", "configurator", "builder"]),
    ("portfolio", ["our work", "portfolio", "case studies", "our projects"]),
    ("services", ["our services", "what we do", "service", "consultation", "contact us for"]),
    ("manufacturing", ["manufacturer", "industrial", "wholesale", "distributor"]),
    ("construction", ["contractor", "construction", "installation", "remodeling"]),
]

INDUSTRY_TERMS = [
    ("sauna", ["sauna", "spa"]),
    ("rv", ["rv", "recreational vehicle", "motorhome", "camper"]),
    ("automotive", ["automotive", "car", "vehicle", "auto"]),
    ("home", ["home", "house", "residential"]),
    ("furniture", ["furniture", "furnishing"]),
    ("technology", ["software", "tech", "digital", "app"]),
    ("fashion", ["fashion", "clothing", "apparel"]),
    ("food", ["restaurant", "food", "catering", "menu"]),
]

NAV_SKIP_MARKERS = ["javascript:", "mailto:", "tel:", "#"]

NAV_CONFIGURATOR_WORDS = ["build", "configure", "customize"]
NAV_SHOP_WORDS = ["shop", "products", "cart"]
NAV_PORTFOLIO_WORDS = ["portfolio", "work", "projects"]
NAV_SERVICE_WORDS = ["services"]
CONFIGURATOR_KEYWORDS = ["configure", "build", "custom"]

# ---------------------------------------------------------------- balanced classifier
PRODUCT_WORDS = [
    "price", "dimensions", "materials", "features",
    "specifications", "size", "capacity", "finish",
    "color", "style", "model", "product", "sku",
    "shipping", "delivery", "warranty", "customize",
    "weight", "height", "width", "depth", "length",
]

CUSTOMIZATION_WORDS = [
    "customize", "customization", "choose your",
    "select your", "options:", "add-ons", "upgrades",
    "configuration", "personalize", "build your",
    "design your", "pick your", "select", "choose",
]

BLOG_WORDS = [
    "published", "posted on", "author:", "written by",
    "tags:", "categories:", "read more", "share this",
    "continue reading", "related posts", "comments",
    "blog post", "article by",
]

CTA_WORDS = [
    "add to cart", "buy now", "get a quote",
    "request quote", "contact for price",
    "purchase", "order now", "shop now",
    "inquire now", "request inquiry",
]

SECTION_WORDS = ["features:", "specifications:", "details:", "materials:"]

BALANCED_PRICE_PATTERNS = [
    r"base\s+price[:\s]*\$[\d,]+",
    r"starting\s+at[:\s]*\$[\d,]+",
    r"price[:\s]*\$[\d,]+",
    r"from\s+\$[\d,]+",
    r"\$[\d,]+(?:\.\d{2})?",
]

ARTICLE_PATTERNS = [
    r"introduction\n",
    r"conclusion\n",
    r"table of contents",
    r"references\n",
    r"further reading",
]

PRODUCT_URL_PATTERNS = [r"/product[s]?/", r"/shop/", r"/item[s]?/", r"/p/", r"/buy/"]
BLOG_URL_PATTERNS = [r"/blog/", r"/news/", r"/article[s]?/", r"/post[s]?/"]
CATEGORY_URL_PATTERNS = [r"/categor(?:y|ies)/", r"/collection[s]?/", r"/all-products", r"/shop/?$"]

NON_PRODUCT_URL_PARTS = [
    "/about", "/contact", "/cart", "/checkout",
    "/account", "/login", "/register", "/privacy",
    "/terms", "/faq", "/help", "/support",
]

HEADER_LINE_PATTERN = r"^([A-Z][^:\n]{2,40}):\s*$"
CHECKBOX_PATTERN = r"-\s*\[[x ]\]"

# name, product threshold, blog threshold, keyword, price and structure weight
STRICTNESS_LEVELS = [
    ("lenient", 3.0, 3.0, 1.0, 2.0, 2.0),
    ("balanced", 5.0, 2.0, 0.8, 2.5, 2.0),
    ("strict", 7.0, 1.0, 0.5, 3.0, 2.5),
]

# ---------------------------------------------------------------- rule-based classifier
STRONG_PRODUCT_URLS = [r"/products?/[^/]+/?$", r"/items?/[^/]+/?$", r"/p/[^/]+/?$"]
STRONG_LIST_URLS = [
    r"/collections?/?$",
    r"/collections?/[^/]+/?$",
    r"/categor(?:y|ies)/?",
    r"/shop/?$",
    r"/products?/?$",
]
STRONG_BLOG_URLS = [r"/blog/", r"/article/", r"/post/", r"/news/"]

RULE_BASE_PRICE = r"(?i)(?:base\s+)?price[:\s]*\$?[\d,]+(?:\.\d{2})?"
RULE_PRICE_MODIFIER = r"\+\s*\$[\d,]+(?:\.\d{2})?|\(\+\$[\d,]+(?:\.\d{2})?\)"
RULE_CHECKBOX = r"-\s*\[[x ]\]\s+(.+)"
RULE_CATEGORY_LINE = r"^(?:#{2,4}\s+)?([A-Z][^:\n]{2,40}):\s*$"
RULE_PURCHASE_CTA = r"(?i)(?:add\s+to\s+cart|buy\s+now|purchase|get\s+quote|request\s+quote)"
RULE_CUSTOM_CTA = r"(?i)(?:customiz|personalis|configure|build\s+your|design\s+your)"
RULE_BLOG_DATE = r"(?i)(?:published|posted|written)\s+(?:on\s+)?"
RULE_BLOG_AUTHOR = r"by\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
RULE_BLOG_TAGS = r"(?i)(?:tags?|categories?):\s*"
RULE_BLOG_WORDS = ["share this", "comments", "reading time"]
RULE_LIST_PHRASES = ["view details", "shop now", "learn more"]
RULE_PAGING_WORDS = ["page", "next", "previous", "showing"]
RULE_CUSTOM_WORDS = ["customize", "choose", "select", "options", "configure"]
RULE_PRODUCT_WORDS = ["specifications", "dimensions", "features", "description"]

# ---------------------------------------------------------------- routing
BLOG_URL_PARTS = [
    "/blog", "/blogs", "/article", "/articles", "/news",
    "/faq", "/faqs", "/questions", "/q-and-a", "/qa",
    "/how-to", "/guide", "/guides", "/tips", "/advice",
    "/learn", "/learning", "/tutorial", "/tutorials",
    "/what-is", "/why-", "/when-", "/where-", "/how-",
    "/resources", "/insights", "/stories", "/posts",
    "?p=", "?page_id=", "?article=", "?post=",
]
ROUTE_CONFIGURATOR_WORDS = ["build", "configure", "customize", "design"]
ROUTE_SEMANTIC_WORDS = ["service", "project", "case-study"]
STATIC_CONFIGURATOR_WORDS = ["configure", "customize", "build", "design", "personalize"]
FALLBACK_EXCLUDED_WORDS = [
    "contact", "about", "privacy", "terms", "login",
    "cart", "checkout", "account", "policy",
]

# ---------------------------------------------------------------- prices
CURRENCY_OF = [
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"),
    ("CAD", "CAD"), ("USD", "USD"), ("EUR", "EUR"), ("GBP", "GBP"),
]
SYMBOL_OF = [("EUR", "€"), ("GBP", "£"), ("JPY", "¥"), ("INR", "₹")]

PRICE_LABELLED = r"(?i)(?:price|cost|from|starting\s+at):\s*\$?([\d,]+(?:\.\d{2})?)\s*(CAD|USD|EUR|GBP)"
PRICE_RANGE = r"(?i)([$€£¥₹])\s*([\d,]+(?:\.\d{2})?)\s*(?:-|to|–)\s*\1?\s*([\d,]+(?:\.\d{2})?)"
PRICE_SYMBOL = r"(?i)([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)"
PRICE_CODE = r"(?i)([\d,]+(?:\.\d{1,2})?)\s*(CAD|USD|EUR|GBP)"
PRICE_FROM = r"(?i)(?:starting\s+)?(?:from|as\s+low\s+as)\s+([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)"
PRICE_BASE = r"(?i)base\s+price:\s*([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)"
PRICE_EXPLICIT_BASE = r"(?i)base\s+price:\s*([$€£¥₹])\s*([\d,]+(?:\.\d{2})?)\s*(CAD|USD|EUR|GBP)?"

OPTION_PRICE_PAREN = r"(?i)\(([+\-]?)\s*([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)\)"
OPTION_PRICE_SIGNED = r"(?i)([+\-])\s*([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)"
OPTION_PRICE_EXTRA = r"(?i)(?:additional|extra|add)\s+([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)"
OPTION_FREE = r"(?i)(?:no\s+(?:additional\s+)?(?:cost|charge)|included|free)"
NAME_WITH_PRICE = r"(?i)^(.+?)\s*\(([+\-]?)\s*([$€£¥₹])\s*([\d,]+(?:\.\d{1,2})?)\)\s*$"
NAME_DASH_PRICE = r"(?i)^(.+?)\s*-\s*\$\s*([\d,]+(?:\.\d{1,2})?)\s*$"

TITLE_PRICE_STRIPS = [
    r"(?i)\s*[-–—]\s*\$[\d,]+(?:\.\d{2})?\s*(?:CAD|USD|EUR|GBP)?",
    r"(?i)\s*\$[\d,]+(?:\.\d{2})?\s*(?:CAD|USD|EUR|GBP)?",
    r"(?i)\s*[€£¥₹][\d,]+(?:\.\d{2})?",
    r"(?i)\s*\([\d,]+(?:\.\d{2})?\s*(?:CAD|USD|EUR|GBP)?\)",
    r"(?i)\s*[-–—]\s*from\s+\$[\d,]+",
    r"(?i)\s*from\s+\$[\d,]+",
]

# ---------------------------------------------------------------- specifications
SPEC_PATTERNS = [
    (r"(?:Dimensions?|Size)", "Dimensions"),
    (r"Length", "Length"),
    (r"Width", "Width"),
    (r"Height", "Height"),
    (r"Depth", "Depth"),
    (r"Weight", "Weight"),
    (r"(?:Capacity|Payload)", "Capacity"),
    (r"(?:GVWR|Gross Vehicle Weight Rating)", "GVWR"),
    (r"Material", "Material"),
    (r"Construction", "Construction"),
    (r"Frame", "Frame"),
    (r"Body", "Body"),
    (r"Engine", "Engine"),
    (r"Motor", "Motor"),
    (r"(?:Horsepower|HP)", "Horsepower"),
    (r"Torque", "Torque"),
    (r"Transmission", "Transmission"),
    (r"Fuel", "Fuel"),
    (r"(?:MPG|Fuel Economy)", "Fuel Economy"),
    (r"(?:Voltage|Power)", "Power"),
    (r"Battery", "Battery"),
    (r"(?:Watts|Wattage)", "Wattage"),
    (r"Model(?:\s+Number)?", "Model Number"),
    (r"SKU", "SKU"),
    (r"Brand", "Brand"),
    (r"Manufacturer", "Manufacturer"),
    (r"Warranty", "Warranty"),
    (r"Year", "Year"),
    (r"Color", "Color"),
    (r"Finish", "Finish"),
]

SPEC_HEADERS = [
    r"specifications?",
    r"technical\s+(?:details|specs|specifications)",
    r"product\s+(?:specs|specifications)",
    r"dimensions?",
    r"materials?",
    r"features?",
    r"description",
    r"read\s*more",
]
FAQ_HEADERS = [r"faq", r"frequently\s+asked\s+questions?", r"questions?", r"q\s*&\s*a"]
QUESTION_PREFIXES = ["can ", "do ", "does ", "is ", "are ", "what ", "why ", "how ", "when ", "where "]
SPEC_KEY_PATTERNS = [
    "dimensions?", "size", "length", "width", "height", "depth",
    "diameter", "weight", "capacity", "material", "finish",
    "frame", "power", "voltage", "wattage", "amperage", "rpm",
    "motor", "engine", "temperature", "humidity",
    "certification", "rating", "color", "model", "sku",
    "brand", "manufacturer", "warranty", "type",
]
SPEC_LIST_LINE = r"^[\s*•\-]+(.{2,50}?):\s*(.{1,120})$"
SPEC_INLINE_LINE = r"^\*?\*?([^*\n:]{2,50})\*?\*?\s*:\s*([^\n]{1,120})$"
NO_SPECS_TEXT = "No specifications available."

# ---------------------------------------------------------------- options
OPTION_CATEGORY_LINE = r"^([A-Z][^:]+?):\s*\*?\s*$"
OPTION_IMAGE = r"!\[(?:Image \d+:?\s*)?([^\]]+?)\s*(?:\(\+?\$[\d,]+\))?\]\(([^\)]+)\)"
OPTION_CHECKBOX = r"^-\s*\[x?\]\s*(.+)"
PRICE_SUFFIXES = [r"\s*\(\+?\$[\d,]+\)\s*$", r"\s*[\+\-]\$[\d,]+\s*$"]
TRACKING_IMAGE_PARTS = ["pixel.wp.com", "g.gif"]
IMAGE_MARKDOWN = r"!\[([^\]]*)\]\(([^\)]+)\)"
LINK_MARKDOWN = r"\[([^\]]+)\]\(([^\)]+)\)"
CONFIGURATOR_IMAGE = r"!\[Image[^:]*:\s*([^\]]+)\]\(([^\)]+)\)"

PAGE_NOISE_WORDS = [
    "you might also like", "recommended", "related products",
    "recently viewed", "suggested", "popular", "trending",
    "total price", "quote request", "sample", "cookie", "privacy",
    "terms", "shipping", "returns", "size guide", "bat.bing",
    "tracking", "analytics", "social", "newsletter", "warning",
]
COLON_NOISE_WORDS = ["you might also like", "recommended", "cookie", "privacy", "terms"]
COLON_BAD_PARTS = ["/", "\\", "(", ")", "http"]
MODEL_SELECTION_WORDS = [
    "model selection", "choose model", "select model",
    "available products", "choose coach", "select coach",
    "available models", "select a coach",
]
PRODUCT_CATEGORY_WORDS = [
    "start by selecting", "select a model", "choose a model",
    "select a coach", "choose a coach", "select your",
    "choose your", "available models", "available coaches",
    "available products", "product selection", "model selection",
]

# ---------------------------------------------------------------- configurators
ACTION_WORDS = [
    "customize", "personalize", "design", "configure", "build",
    "create", "make your own", "start designing", "start building",
]
INDICATOR_WORDS = [
    "choose", "select", "pick", "add", "upgrade",
    "option", "variant", "color", "size", "material",
]
LINK_URL_WORDS = ["custom", "config", "builder", "design", "personalize", "create", "build"]
BUTTON_PHRASES = ["get started", "start now", "begin", "design now"]
DROPDOWN_WORDS = ["select from", "choose from", "dropdown", "select:"]
RADIO_PATTERNS = [r"\(\s*\)\s+", r"○\s+", r"◯\s+"]
VARIANT_PRICE_PATTERNS = [
    r"\$[\d,]+(?:\.\d{2})?",
    r"[\d,]+(?:\.\d{2})?\s*(?:CAD|USD|EUR|GBP)",
    r"\+\s*\$[\d,]+",
]
GROUP_HEADERS = [r"^#+\s+", r"^[A-Z][^:]{3,30}:\s*$", r"^\*\*[A-Z][^*]+\*\*\s*$"]
GROUP_ITEMS = [r"^[-*•]\s+", r"^\d+\.\s+", r"^-\s*\[[x ]\]"]
PLATFORM_OF = [
    ("threekit", "threekit"),
    ("zakeke", "zakeke"),
    ("customily", "customily"),
    ("productimize", "productimize"),
    ("inksoft", "inksoft"),
    ("printful", "printful"),
    ("shopify", "shopify"),
    ("woocommerce", "woocommerce"),
    ("bigcommerce", "bigcommerce"),
    ("nike", "nike_by_you"),
    ("adidas", "adidas_miadidas"),
]
SCRIPT_HEAVY_MARKERS = [
    "react", "vue", "angular", "next.js", "gatsby",
    "javascript required", "js required", "enable javascript",
    "noscript", "__next", "_app", "webpack", "bundle.js",
    "app.js", "main.js", "vendor.js",
]

# ---------------------------------------------------------------- colours
SWATCH_WORDS = [
    "color", "colour", "colors", "colours",
    "finish", "finishes",
    "wood type", "wood types", "wood species",
    "stain", "stains",
    "paint", "coating",
    "material", "materials",
    "surface", "surfaces",
    "tone", "tones", "shade", "shades",
]
SWATCH_FILE_PATTERNS = [
    r"color", r"colour", r"swatch", r"palette",
    r"finish", r"wood[-_]", r"stain", r"tone",
    r"sample", r"chip",
]
STRONG_FILE_PATTERNS = [
    r"color[-_]swatch", r"swatch[-_]", r"palette", r"color[-_]wheel", r"finish[-_]options",
]
COLOUR_WORDS = [
    "black", "white", "gray", "grey", "brown",
    "red", "blue", "green", "yellow", "orange",
    "beige", "tan", "cream", "ivory",
    "walnut", "oak", "cherry", "maple", "pine",
    "mahogany", "teak", "cedar", "ash",
    "natural", "dark", "light", "medium",
]
STRONG_SWATCH_PHRASES = [
    "choose your color", "select your color",
    "available colors", "color options",
    "pick a color", "available finishes",
    "wood species", "stain colors",
]
CHOICE_WORDS = ["available", "choose", "select"]
COLOUR_CATEGORY_WORDS = ["color", "finish", "wood", "stain", "shade"]

# name, low corner, high corner
COLOUR_BOXES = [
    ("black", (0, 0, 0), (30, 30, 30)),
    ("charcoal", (30, 30, 30), (60, 60, 60)),
    ("dark gray", (60, 60, 60), (100, 100, 100)),
    ("gray", (100, 100, 100), (150, 150, 150)),
    ("light gray", (150, 150, 150), (200, 200, 200)),
    ("silver", (190, 190, 190), (220, 220, 220)),
    ("white", (240, 240, 240), (255, 255, 255)),
    ("dark brown", (40, 20, 10), (80, 50, 30)),
    ("walnut", (80, 50, 30), (100, 70, 50)),
    ("brown", (100, 60, 30), (140, 90, 60)),
    ("medium brown", (120, 80, 50), (160, 110, 80)),
    ("light brown", (160, 120, 90), (200, 170, 140)),
    ("tan", (180, 150, 120), (220, 190, 160)),
    ("beige", (220, 200, 180), (240, 230, 210)),
    ("mahogany", (90, 40, 30), (120, 60, 40)),
    ("cherry", (140, 70, 50), (180, 100, 70)),
    ("oak", (180, 140, 100), (210, 170, 130)),
    ("maple", (220, 190, 150), (240, 220, 190)),
    ("natural wood", (200, 160, 120), (230, 200, 170)),
    ("red", (200, 0, 0), (255, 80, 80)),
    ("blue", (0, 80, 200), (100, 150, 255)),
    ("green", (0, 150, 50), (100, 200, 100)),
    ("yellow", (200, 200, 0), (255, 255, 100)),
    ("orange", (255, 140, 0), (255, 180, 50)),
    ("cream", (240, 230, 210), (255, 250, 240)),
    ("ivory", (250, 245, 230), (255, 255, 245)),
    ("off-white", (245, 245, 240), (255, 255, 250)),
]
FAMILY_WORDS = [
    ("Grayscale", ["gray", "grey", "black", "white", "charcoal"]),
    ("Browns & Woods", ["brown", "walnut", "oak", "cherry", "wood", "mahogany"]),
    ("Reds", ["red"]),
    ("Blues", ["blue"]),
    ("Greens", ["green"]),
    ("Neutrals", ["beige", "tan", "cream", "ivory"]),
]

# ---------------------------------------------------------------- catalog
SHEET_HEADER = ["Categories", "Component", "References"]
PRICED_HEADER = ["Categories", "Component", "Price", "Image", "Notes", "References"]
UNPRICED_HEADER = ["Categories", "Component", "Image", "References"]
QUOTATION_TEXT = "Select options to generate quotations"
