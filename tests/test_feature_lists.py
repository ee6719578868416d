"""Features by lists of the caller's own, and with empty lists."""

from hostlens.functions.features import with_features
from hostlens.functions.lists import FeatureLists

HOSTS = ["kiosk.example.com", "k1osk-mail.org", "kiosk.org", "my-kioks.net", "a.kiosk.host.io", "it's.host.io", "paypal-login.xyz", "", None]


def rows(spark, given):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HOSTS)], "i int, hostname string")
    return {r.hostname: r for r in with_features(df, given=given).collect()}


def test_own_lists(spark):
    given = FeatureLists(
        brands={"kiosk": ("kiosk.org",), "host": ()}, whole_token_brands=("host",), keywords=("mail", "it's", "mail"),
        free_hosting=("host.io",), risky_endings=("org", "net"),
    )
    got = rows(spark, given)
    assert {h: r.brand_impersonation for h, r in got.items()} == {
        "kiosk.example.com": 1, "k1osk-mail.org": 0, "kiosk.org": 0, "my-kioks.net": 0, "a.kiosk.host.io": 1,
        "it's.host.io": 1, "paypal-login.xyz": 0, "": 0, None: 0,
    }
    assert [h for h, r in got.items() if r.name_brand_lookalike] == ["k1osk-mail.org", "my-kioks.net"]
    assert {h: r.suspicious_keyword_count for h, r in got.items() if r.suspicious_keyword_count} == {"k1osk-mail.org": 1, "it's.host.io": 1}
    assert [h for h, r in got.items() if r.is_free_hosting] == ["a.kiosk.host.io", "it's.host.io"]
    assert got["a.kiosk.host.io"].name_length == 5 and got["it's.host.io"].name_keyword_count == 1
    assert [h for h, r in got.items() if r.tld_risky] == ["k1osk-mail.org", "kiosk.org", "my-kioks.net"]


def test_empty_lists(spark):
    got = rows(spark, FeatureLists({}, (), (), (), ()))
    listed = ("brand_impersonation", "name_brand_lookalike", "name_homoglyph_brand", "suspicious_keyword_count",
              "name_keyword_count", "is_free_hosting", "tld_risky")
    assert {r[c] for r in got.values() for c in listed} == {0}
    assert got["a.kiosk.host.io"].name_length == 4


def test_default_lists_stay(spark):
    got = rows(spark, FeatureLists())["paypal-login.xyz"]
    assert (got.brand_impersonation, got.suspicious_keyword_count, got.tld_risky) == (1, 1, 1)
