"""Word lists, lookup tables, thresholds, texts and formats.

Everything here is a constant of the data model.  Results are only comparable with
other producers of the same event and dataset formats if these values are equal.
"""

from __future__ import annotations

# --- hosts and URLs ---------------------------------------------------------

DATE_IN_FILE_NAME = r"(\d{4}-\d{2}-\d{2})"
URL_SCHEMES = ("http", "https")
DEFAULT_PORTS = {"http": 80, "https": 443}
EMPTY_LITERALS = ("", "-", "--", "---", "n/a", "na", "none", "null", "unknown")
REFUSED_PREFIXES = ("javascript:", "data:", "about:blank")
TRACKING_PARAMS = (
    "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src", "source", "spm",
    "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_name", "utm_source", "utm_term", "yclid",
)

# --- feature vocabularies ---------------------------------------------------

SENSITIVE_KEYWORDS = (
    "account", "admin", "auth", "bank", "billing", "bonus", "claim", "confirm", "gift", "invoice",
    "login", "mfa", "oauth", "password", "payment", "recover", "reset", "secure", "service", "session",
    "signin", "support", "token", "unlock", "update", "verify", "wallet", "webscr",
)
BRANDS = (
    "adobe", "amazon", "amex", "apple", "bankofamerica", "binance", "chase", "citi", "coinbase", "dhl",
    "docusign", "dropbox", "facebook", "fedex", "google", "icloud", "instagram", "microsoft", "netflix",
    "office365", "outlook", "paypal", "roblox", "shopee", "telegram", "usps", "whatsapp",
)
TLD_RISK = {
    "buzz": 0.6, "cam": 0.5, "cf": 1.0, "click": 0.8, "country": 0.5, "fit": 0.5, "ga": 1.0, "gq": 1.0,
    "live": 0.6, "ml": 1.0, "mom": 0.5, "monster": 0.6, "online": 0.7, "quest": 0.5, "rest": 0.6,
    "run": 0.5, "shop": 0.7, "site": 0.7, "support": 0.5, "tk": 1.0, "today": 0.5, "top": 0.8,
    "vip": 0.6, "work": 0.6, "xyz": 0.8,
}
CONSONANTS = "bcdfghjklmnpqrstvwxyz"

DOMAIN_FEATURES = (
    "domain_length", "subdomain_count", "num_tokens_domain", "num_hyphens", "digit_ratio",
    "entropy_domain", "contains_brand_name", "contains_sensitive_keyword",
    "edit_distance_to_top_brand", "tld_risk_score", "brand_position_score",
    "registered_domain_length", "consonant_run_max", "char_repeat_ratio", "is_idn_or_punycode",
)
URL_FEATURES = (
    "sample_length", "hostname_length", "registered_domain_length", "subdomain_length", "path_length",
    "query_length", "fragment_length", "dot_count", "hyphen_count", "underscore_count", "slash_count",
    "digit_count", "question_mark_count", "ampersand_count", "equal_count", "at_count",
    "percent_count", "tilde_count", "colon_count", "alpha_count", "alnum_count",
    "special_char_count", "digit_ratio", "special_char_ratio", "unique_char_ratio",
    "sample_entropy", "hostname_entropy", "subdomain_depth", "path_depth", "query_param_count",
    "suspicious_token_count", "has_https_token_in_host", "uses_http_scheme", "uses_https_scheme",
    "has_fragment", "has_query", "has_ip_host",
)

# --- feeds ------------------------------------------------------------------

# name -> (label or None when the file carries it, record_type, fixed date or None, opt-in, target text)
FEEDS = {
    "phishtank": (1, "url", None, False, None),
    "openphish": (1, "url", None, True, ""),
    "news_sitemaps": (0, "url", None, False, None),
    "mendeley_phishing_url": (None, "url", "2024-04-02", False, "10.17632/vfszbj9b36.1"),
    "mendeley_legitphish": (None, "url", "2025-04-07", False, "10.17632/hx4m73v2sf.1"),
    "tranco": (0, "domain", None, False, ""),
}
EXTRA_FEED_DIRS = {"openphish": ("openphish_snapshots",)}
DEFAULT_FEEDS = ("tranco", "mendeley_phishing_url", "mendeley_legitphish")
DEFAULT_TOP_N = 100_000
ADDON_SOURCE = "vn_benign_domain_addon"
ADDON_DATE = "2025-04-07"

# --- news sitemaps ----------------------------------------------------------

NEWS_SITEMAP_PATHS = (
    "/news-sitemap.xml", "/news_sitemap.xml", "/news.xml", "/sitemap-news.xml", "/sitemap_news.xml",
    "/sitemap.xml", "/sitemap_index.xml",
)
NEWS_BLOCKED_TOKENS = (
    "/amp", "/author/", "/authors/", "/category/", "/categories/", "/live/", "/podcast/", "/podcasts/",
    "/profile/", "/profiles/", "/search", "/section/", "/sections/", "/tag/", "/tags/", "/topic/",
    "/topics/", "/video/", "/videos/", "account", "login", "newsletter", "register", "signin",
    "signup", "subscribe",
)
NEWS_BLOCKED_ENDINGS = (
    ".css", ".csv", ".gif", ".jpeg", ".jpg", ".js", ".json", ".mp3", ".mp4", ".pdf", ".png", ".rss",
    ".svg", ".txt", ".xml", ".zip", "/rss",
)
# An ampersand of sitemap text that begins no reference.
BARE_AMPERSAND = r"&(?!amp;|apos;|gt;|lt;|quot;|#\d+;|#x[0-9A-Fa-f]+;)"
NEWS_LOOKBACK_DAYS = 7
NEWS_MAX_URLS = 500
NEWS_MAX_SITEMAPS = 25

# --- site seeds -------------------------------------------------------------

SITE_SITEMAP_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap_news.xml", "/sitemap-news.xml",
)
PORTAL_KEYWORDS = (
    "account", "auth", "billing", "dang-nhap", "daotao", "elearning", "hocphi", "hoc-vu", "hocvu",
    "login", "mail", "portal", "sinhvien", "sso", "student", "support", "tra-cuu",
)
SITE_MAX_URLS = 18

# --- seed categories (tested in this order) ---------------------------------

CATEGORY_TOKENS = {
    "banking_payment": ("bank", "bancolombia", "paypal", "payment", "pay", "securepay", "invoice"),
    "crypto_wallet": (
        "trezor", "ledger", "metamask", "wallet", "bitmart", "coinbase", "binance", "crypto",
    ),
    "ecommerce_delivery": ("amazon", "dhl", "dpd", "fedex", "usps", "delivery", "package", "order"),
    "cloud_email_docs": (
        "onedrive", "office365", "outlook", "icloud", "mail", "xfinity", "pdf", "doc", "viewpdf",
    ),
    "social_gaming": ("roblox", "robiox", "spotify", "facebook", "instagram", "telegram"),
}
OTHER_CATEGORY = "generic_portal"
CATEGORY_PRIORITY = {
    "banking_payment": "critical",
    "crypto_wallet": "critical",
    "cloud_email_docs": "high",
    "ecommerce_delivery": "high",
    "social_gaming": "high",
    "generic_portal": "medium",
}
CATEGORY_TURN = (
    "banking_payment", "crypto_wallet", "cloud_email_docs", "ecommerce_delivery", "social_gaming",
    "generic_portal",
)

# --- risk, advice and signals (event log texts) -----------------------------

RISK_BANDS = (("high", 0.5), ("medium", 0.60), ("low", 0.35))
LOWEST_RISK = "minimal"
ADVICE = {
    "alert_now": "Gửi cảnh báo ngay cho người dùng và đánh dấu sự kiện để SOC kiểm tra.",
    "show_and_watch": "Hiển thị cảnh báo trên dashboard và theo dõi thêm các truy cập tiếp theo.",
    "keep_in_log": "Giữ sự kiện trong log để theo dõi, chưa cần cảnh báo mạnh.",
    "no_alert": "Không cần cảnh báo mạnh; tiếp tục ghi log để đối chiếu hành vi.",
}
SIGNAL_TEXT = {
    "brand": "Hostname chứa token trùng với thương hiệu phổ biến.",
    "host_keyword": "Hostname chứa từ khóa nhạy cảm như login, verify hoặc payment.",
    "near_brand": "Hostname rất gần với tên thương hiệu thật, có dấu hiệu giả mạo.",
    "risky_tld": "TLD `.{suffix}` nằm trong nhóm rủi ro cao hơn bình thường.",
    "host_digits": "Hostname có tỷ lệ chữ số cao bất thường.",
    "punycode": "Hostname dùng IDN hoặc punycode.",
    "url_keyword": "URL chứa từ khóa thường gặp trong phishing như login, verify hoặc reset.",
    "plain_http": "URL chỉ dùng HTTP, không có HTTPS.",
    "https_in_host": "Hostname chứa chuỗi `https`, đây là mẫu đánh lừa phổ biến.",
    "ip_host": "URL dùng địa chỉ IP thay vì domain.",
    "many_params": "URL có nhiều tham số query hơn mức thông thường.",
    "special_chars": "URL có tỷ lệ ký tự đặc biệt cao.",
}
MAX_SIGNALS = 4

# --- models -----------------------------------------------------------------

MODEL_ORDER = (
    "logistic_regression", "linear_svm", "random_forest", "xgboost", "ann_mlp", "hybrid_lr_xgboost_ann",
)
SELECTION_METRICS = ("f1", "precision", "recall", "roc_auc", "pr_auc")
SEED = 42
NO_KIND = "nan"  # how a missing kind is named in errors

# Notes of seed rows.
SEED_NOTES = {
    "domain": "Hostname extracted from OpenPhish snapshot {}.",
    "url": "URL selected from OpenPhish snapshot {}.",
}
