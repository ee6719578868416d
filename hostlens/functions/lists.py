"""Fixed values that the features are defined by (brands, words, hosts, endings)."""

from dataclasses import dataclass, field

# Brand word -> registered domains the brand owns.
BRAND_DOMAINS = {
    "paypal": ("paypal.com", "paypal.me"),
    "apple": ("apple.com", "icloud.com"),
    "microsoft": ("microsoft.com", "live.com", "office.com", "microsoftonline.com"),
    "amazon": (
        "amazon.com", "amazon.co.uk", "amazon.de", "amazon.fr", "amazon.in", "amazonaws.com",
    ),
    "netflix": ("netflix.com",),
    "google": (
        "google.com", "google.co.uk", "google.fr", "google.de", "googleapis.com",
        "gmail.com", "youtube.com",
    ),
    "facebook": ("facebook.com", "fb.com", "facebookmail.com", "fbcdn.net"),
    "instagram": ("instagram.com",),
    "whatsapp": ("whatsapp.com", "whatsapp.net"),
    "dhl": ("dhl.com", "dhl.de"),
    "office365": ("office365.com", "office.com", "microsoft.com"),
    "outlook": ("outlook.com", "live.com", "office.com"),
    "chase": ("chase.com",),
    "wellsfargo": ("wellsfargo.com",),
    "bankofamerica": ("bankofamerica.com",),
    "citibank": ("citibank.com", "citi.com"),
    "hsbc": ("hsbc.com", "hsbc.co.uk"),
    "barclays": ("barclays.com", "barclays.co.uk"),
}

# Brands that count only as a whole token between dots and hyphens.
WHOLE_TOKEN_BRANDS = ("apple", "chase", "dhl", "citibank", "hsbc", "outlook")

# Words that phishing hostnames like to carry.
SUSPICIOUS_KEYWORDS = (
    "login", "secure", "verify", "account", "update",
    "signin", "banking", "confirm", "wallet", "support",
)

# Registered domains where anybody can host a site.
FREE_HOSTING_DOMAINS = (
    "web.app", "firebaseapp.com", "repl.co", "weeblysite.com", "ipfs.io",
    "github.io", "netlify.app", "vercel.app", "pages.dev", "wixsite.com",
    "blogspot.com", "000webhostapp.com", "glitch.me",
)

# Top-level domains with a high share of abuse.
RISKY_TLDS = (
    "xyz", "top", "club", "online", "site", "icu", "buzz", "live", "shop", "info",
)

# Limits of the edit-distance lookalike test.
LOOKALIKE_MIN_BRAND_LENGTH = 5
LOOKALIKE_MIN_TOKEN_LENGTH = 5
LOOKALIKE_MAX_DISTANCE = 2

# Look-alike spellings; pairs first, then single characters.
HOMOGLYPH_PAIRS = (("rn", "m"), ("vv", "w"))
HOMOGLYPH_DIGITS = ("0135", "oles")

# Feature names in model order.
BASE_FEATURES = (
    "hostname_length", "num_labels", "num_subdomain_levels", "num_digits",
    "digit_ratio", "num_hyphens", "longest_label_length", "domain_entropy",
    "vowel_ratio", "is_ip", "is_punycode", "brand_impersonation",
    "suspicious_keyword_count", "is_free_hosting", "tld_risky",
)
NAME_FEATURES = (
    "name_length", "name_entropy", "name_digit_ratio", "name_num_hyphens",
    "name_keyword_count", "name_brand_lookalike", "name_homoglyph_brand",
)
FEATURES = BASE_FEATURES + NAME_FEATURES

# Features compared as proportions; the others by their distribution.
BINARY_FEATURES = (
    "is_ip", "is_punycode", "brand_impersonation", "is_free_hosting",
    "tld_risky", "name_brand_lookalike", "name_homoglyph_brand",
)
NUMERIC_FEATURES = tuple(f for f in FEATURES if f not in BINARY_FEATURES)

# Signal text and the feature that fires it, in report order.
SIGNALS = (
    ("is_free_hosting", "free hosting"),
    ("tld_risky", "risky TLD"),
    ("brand_impersonation", "brand impersonation"),
    ("name_brand_lookalike", "brand lookalike"),
    ("name_homoglyph_brand", "brand homoglyph"),
    ("suspicious_keyword_count", "suspicious keywords"),
    ("is_ip", "IP address"),
    ("is_punycode", "punycode"),
)


@dataclass(frozen=True)
class FeatureLists:
    """The lists that the features read, each replaceable. `brands`: brand word -> domains it owns (none is
    fine). Meant for up to some hundred entries; see operators.brands for long lists of brands."""

    brands: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(BRAND_DOMAINS))
    whole_token_brands: tuple[str, ...] = WHOLE_TOKEN_BRANDS
    keywords: tuple[str, ...] = SUSPICIOUS_KEYWORDS
    free_hosting: tuple[str, ...] = FREE_HOSTING_DOMAINS
    risky_endings: tuple[str, ...] = RISKY_TLDS
