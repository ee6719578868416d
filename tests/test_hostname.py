import random

import pytest
from pyspark.sql import functions as F

from hostlens.functions import hostname as H
from hostlens.functions.suffix import read_rules

# What the rules leave open to argument, one by one.
SPECIAL = [
    ("http://a@b@c.org/x@y", "c.org"),
    ("http://e.org/@at", "e.org"),
    ("//e.org/x", ""),
    ("www.www.e.org", "www.e.org"),
    ("e.org..", "e.org"),
    (" e.org\t\n", "e.org"),
    ("e.org /x", "e.org "),
    ("http://[[::1]/", "::1"),
    ("http://x.org\n.y/z", "x.org\n.y"),
    (None, ""),
]


def one_column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def assembled(n, seed):
    """(url, host): URLs put together from their parts, so that the host is known without parsing."""
    r = random.Random(seed)

    def word(letters="abcdefghijklmnopqrstuvwxyz0123456789-"):
        return "".join(r.choices(letters, k=r.randrange(1, 9)))

    for _ in range(n):
        name = ".".join(word() for _ in range(r.randrange(1, 5)))
        kind = r.choice(["name", "name", "name", "v4", "v6", "none"])
        if kind == "v4":
            name = ".".join(str(r.randrange(256)) for _ in range(4))
        elif kind == "v6":
            name = ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8))
        elif kind == "none":
            name = ""
        mixed = "".join(r.choice((c, c.upper())) for c in name)
        host = f"[{mixed}]" if kind == "v6" else r.choice(["", "", "www.", "Www."]) + mixed
        if kind != "v6":
            host += "." * r.choice([0, 0, 0, 1, 3])
        scheme = r.choice(["http", "HTTPS", "a+b-c.d", "x"]) + "://" if kind in ("v6", "none") or r.random() < 0.6 else ""
        user = r.choice(["", "", f"{word()}@", f"{word()}:{word()}@", f"{word()}@{word()}@"])
        port = r.choice(["", "", ":", f":{r.randrange(65536)}"])
        tail = r.choice(["", "/", f"/{word()}@{word()}:{word()}", f"?{word()}=//{word()}", f"#{word()}/[{word()}]"])
        pad = r.choice(["", " ", "\t", "\n "])
        yield pad + scheme + user + host + port + tail + pad, name


def test_normalize(spark):
    cases = [*assembled(600, 3), *SPECIAL]
    df = one_column(spark, [u for u, _ in cases], "url")
    got = [r[0] for r in df.orderBy("i").select(H.url_to_hostname(F.col("url"))).collect()]
    assert [(u, g) for (u, _), g in zip(cases, got)] == cases


def test_blank_urls_have_no_host(spark):
    df = one_column(spark, [" " * n + t for n in (0, 1, 7) for t in ("", "\r", "\x1f")], "url")
    assert {r[0] for r in df.select(H.url_to_hostname(F.col("url"))).collect()} == {""}


@pytest.mark.parametrize(
    "url, reason",
    [
        ("", "empty url"),
        (None, "empty url"),
        ("https://", "no hostname"),
        ("a" * 2049, "url too long"),
        ("a" * 254, "hostname too long"),
        ("a b.org", "space or control character"),
        ("a\x01b.org", "space or control character"),
        ("https://www.example.com/", None),
    ],
)
def test_reject_reason(spark, url, reason):
    df = one_column(spark, [url], "url").withColumn("h", H.url_to_hostname(F.col("url")))
    assert df.select(H.reject_reason(F.col("url"), F.col("h"))).first()[0] == reason


IPS = {
    "192.168.0.1": True, "0.0.0.0": True, "255.255.255.255": True, "1.2.3.4.5": False,
    "256.1.1.1": False, "1.2.3": False, "01.2.3.4": False, "1234": False, "a.b.c.d": False,
    "2001:db8::1": True, "::": True, "::1": True, "1::": True, "1:2:3:4:5:6:7:8": True,
    "1:2:3:4:5:6:7::": True, "1:2:3:4:5:6:7:8::": False, "1::2:3:4:5:6:7:8": False,
    "1::3:4:5:6:7:8": True, "1:2:3": False, "::ffff:1.2.3.4": True, "1:2:3:4:5:6:1.2.3.4": True,
    "::1.2.3.256": False, "1::2::3": False, ":1": False, "1:": False, "12345::": False,
    "fe80::1%eth0": True, "fe80::1%": False, "g::": False, "::1.2.3.4:5": False, "": False,
    ":::": False,
}


def test_is_ip(spark):
    import ipaddress

    df = one_column(spark, list(IPS))
    got = dict(df.select("v", H.is_ip(F.col("v"))).collect())
    assert got == IPS
    for text, expected in IPS.items():
        try:
            ipaddress.ip_address(text)
            assert expected, text
        except ValueError:
            assert not expected, text


# host -> subdomain, domain label, suffix, registered domain, effective name
SPLITS = {
    "mail.google.com": ("mail", "google", "com", "google.com", "google"),
    "a.b.netlify.app": ("a.b", "netlify", "app", "netlify.app", "b"),
    "github.io": ("", "github", "io", "github.io", "github"),
    "paypa1-verify.github.io": (
        "paypa1-verify", "github", "io", "github.io", "paypa1-verify",
    ),
    "mail.example.co.uk": ("mail", "example", "co.uk", "example.co.uk", "example"),
    "co.uk": ("", "", "co.uk", "co.uk", ""),
    "localhost": ("", "localhost", "", "localhost", "localhost"),
    "a.b.nosuchtld": ("a.b", "nosuchtld", "", "a.b.nosuchtld", "nosuchtld"),
    "x.foo.ck": ("", "x", "foo.ck", "x.foo.ck", "x"),
    "y.www.ck": ("y", "www", "ck", "www.ck", "www"),
    "a.b.c.kobe.jp": ("a", "b", "c.kobe.jp", "b.c.kobe.jp", "b"),
    "a.city.kobe.jp": ("a", "city", "kobe.jp", "city.kobe.jp", "city"),
    "192.168.0.1": ("", "192.168.0.1", "", "192.168.0.1", ""),
    "": ("", "", "", "", ""),
    "foo.zz": ("foo", "zz", "", "foo.zz", "zz"),
}


def test_split_suffix(spark):
    df = H.with_host_parts(one_column(spark, list(SPLITS), "hostname"))
    rows = df.select(
        "hostname", "subdomain", "domain_label", "suffix", "registered_domain", "effective_name"
    ).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert got == SPLITS


def test_rules_from_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text(
        "// comment\ncom\nuk\nco.uk\n*.ck\n!www.ck\n// ===END ICANN DOMAINS===\ngithub.io\n"
    )
    rules = read_rules(spark, str(path))
    assert sorted(r.name for r in rules.rules.collect()) == ["ck", "co.uk", "com", "uk", "www.ck"]
    df = H.with_registered_domain(
        one_column(spark, ["a.b.co.uk", "a.www.ck", "q.w.e.ck", "a.github.io"], "hostname"),
        rules=rules,
    )
    assert dict(df.select("hostname", "registered_domain").collect()) == {
        "a.b.co.uk": "b.co.uk", "a.www.ck": "www.ck", "q.w.e.ck": "w.e.ck",
        "a.github.io": "a.github.io",
    }
