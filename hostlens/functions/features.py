"""The 22 lexical hostname features as built-in expressions: one scan stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions import lists
from hostlens.functions.hostname import PARTS, with_host_parts
from hostlens.functions.lists import FeatureLists
from hostlens.functions.suffix import SuffixRules, SuffixTable


def label_count(host: Column) -> Column:
    """Labels between dots, empty ones included; none in an empty host."""
    return F.when(host == "", 0).otherwise(F.regexp_count(host, F.lit(r"\.")) + 1)


def digit_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def hyphen_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "-", ""))


def ratio(part: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, part / F.length(text)).otherwise(0.0)


def longest_label(host: Column) -> Column:
    return F.array_max(F.transform(F.split(host, r"\."), F.length))


def shannon_entropy(text: Column) -> Column:
    """Bits per character of the character distribution; 0 for an empty text."""
    n = F.length(text)

    def bits(total: Column, char: Column) -> Column:
        share = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - share * F.log2(share)

    chars = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), bits)).otherwise(0.0)


def vowel_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "aeiou", ""))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(text: str, values) -> str:
    return f"{text} IN (" + ", ".join(map(_text, values)) + ")" if values else "false"


def _any(hits: list[str]) -> str:
    return " OR ".join(hits) or "false"


# The list-driven features are SQL text: a single parse instead of hundreds of driver calls.


def keyword_count(text: str, given: FeatureLists = FeatureLists()) -> Column:
    """How many of the suspicious words occur; each counts once."""
    hits = [f"int(contains({text}, {_text(word)}))" for word in dict.fromkeys(given.keywords)]
    return F.expr(" + ".join(hits) or "0")


def brand_impersonation(host: str, registered: str, given: FeatureLists = FeatureLists()) -> Column:
    """A brand appears in a host whose registered domain the brand does not own."""
    hits = []
    for brand, owned in given.brands.items():
        if brand in given.whole_token_brands:
            seen = f"contains('.' || translate({host}, '-', '.') || '.', {_text(f'.{brand}.')})"
        else:
            seen = f"contains({host}, {_text(brand)})"
        hits.append(f"({seen} AND NOT ({_in(registered, owned)}))")
    return F.expr(_any(hits))


def brand_lookalike(name: str, registered: str, given: FeatureLists = FeatureLists()) -> Column:
    """A token of the name lies within a small edit distance of a brand, but is not it."""
    limit = lists.LOOKALIKE_MAX_DISTANCE
    hits = [
        f"(length(t) BETWEEN {len(brand) - limit} AND {len(brand) + limit} AND t != {_text(brand)}"
        f" AND NOT ({_in(registered, owned)})"
        f" AND levenshtein(t, {_text(brand)}, {limit}) BETWEEN 0 AND {limit})"
        for brand, owned in given.brands.items()
        if len(brand) >= lists.LOOKALIKE_MIN_BRAND_LENGTH
    ]
    long_enough = f"length(t) >= {lists.LOOKALIKE_MIN_TOKEN_LENGTH}"
    return F.expr(f"exists(split({name}, '-'), t -> {long_enough} AND ({_any(hits)}))")


def unfold_homoglyphs(token: str) -> str:
    for seen, meant in lists.HOMOGLYPH_PAIRS:
        token = f"replace({token}, '{seen}', '{meant}')"
    seen, meant = lists.HOMOGLYPH_DIGITS
    return f"translate({token}, '{seen}', '{meant}')"


def homoglyph_brand(name: str, registered: str, given: FeatureLists = FeatureLists()) -> Column:
    """A token spells a brand once look-alike characters are read as they look."""
    owned = [f"{b}|{d}" for b, domains in given.brands.items() for d in domains]
    meant = unfold_homoglyphs("t")
    return F.expr(
        f"exists(split({name}, '-'), t -> {meant} != t AND {_in(meant, given.brands)}"
        f" AND NOT ({_in(f'{meant} || {_text("|")} || {registered}', owned)}))"
    )


def feature_columns(host_name: str, given: FeatureLists = FeatureLists()) -> list[Column]:
    """The features in model order, from a host column and its PARTS."""
    host, sub = F.col(host_name), F.col("subdomain")
    domain, name = F.col("domain_label"), F.col("effective_name")
    own = ("effective_name", "registered_domain")
    values = {
        "hostname_length": F.length(host),
        "num_labels": label_count(host),
        "num_subdomain_levels": label_count(sub),
        "num_digits": digit_count(host),
        "digit_ratio": ratio(digit_count(host), host),
        "num_hyphens": hyphen_count(host),
        "longest_label_length": longest_label(host),
        "domain_entropy": shannon_entropy(domain),
        "vowel_ratio": ratio(vowel_count(domain), domain),
        "is_ip": F.col("is_ip").cast("int"),
        "is_punycode": host.contains("xn--").cast("int"),
        "brand_impersonation": brand_impersonation(host_name, "registered_domain", given).cast("int"),
        "suspicious_keyword_count": keyword_count(host_name, given),
        "is_free_hosting": F.expr(f"int({_in('registered_domain', given.free_hosting)})"),
        "tld_risky": F.expr(f"int({_in("substring_index(suffix, '.', -1)", given.risky_endings)})"),
        "name_length": F.length(name),
        "name_entropy": shannon_entropy(name),
        "name_digit_ratio": ratio(digit_count(name), name),
        "name_num_hyphens": hyphen_count(name),
        "name_keyword_count": keyword_count("effective_name", given),
        "name_brand_lookalike": brand_lookalike(*own, given).cast("int"),
        "name_homoglyph_brand": homoglyph_brand(*own, given).cast("int"),
    }
    return [values[f].alias(f) for f in lists.FEATURES]


def with_features(
    df: DataFrame,
    host: str = "hostname",
    rules: SuffixRules | SuffixTable | None = None,
    keep_parts: tuple[str, ...] = (),
    given: FeatureLists = FeatureLists(),
) -> DataFrame:
    """Add the 22 features (and the named PARTS), by the given lists; a host is read trimmed and lowercased."""
    keep_parts = tuple(p for p in PARTS if p in keep_parts or p in df.columns)
    keep = [c for c in df.columns if c not in PARTS and c not in lists.FEATURES]
    df = df.select(*keep).withColumn("_host", F.lower(F.trim(F.coalesce(host, F.lit("")))))
    df = with_host_parts(df, "_host", rules, given.free_hosting)
    return df.select(*keep, *keep_parts, *feature_columns("_host", given))


def clean_looking() -> Column:
    """Ordinary-looking host: no subdomain, digit or hyphen, safe ending, not free hosting."""
    return (
        (F.col("num_subdomain_levels") == 0) & (F.col("num_digits") == 0)
        & (F.col("num_hyphens") == 0) & (F.col("tld_risky") == 0)
        & (F.col("is_free_hosting") == 0) & (F.col("is_ip") == 0)
    )
