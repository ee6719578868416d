"""Dataset build, training and streaming on small fixtures."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostlens.functions.features import with_features
from hostlens.operators import metrics
from hostlens.plans import dataset as ds
from hostlens.plans import training as tr
from hostlens.sources import io
from hostlens.streaming import scoring as st


@pytest.fixture(scope="module")
def built(spark):
    urls = [
        (0, "https://a.evil.xyz/1", 1), (1, "https://a.evil.xyz/1", 0), (2, "http://a.evil.xyz/2", 1),
        (3, "http://both.com", 1), (4, "http://both.com/x", 0), (5, "https://", 0),
        (6, "http://sub.good.com", 1), (7, "www.fine.org", 0), (8, "http://10.0.0.1/", 1),
    ] + [(100 + i, f"http://p{i}.github.io/", 1) for i in range(40)] + [
        (200 + i, f"http://site{i}.net", i % 2) for i in range(60)
    ]
    raw = spark.createDataFrame(urls, "url_id int, url string, label int").repartition(4)
    a = [(1, "mail.good.com"), (2, "sub.good.com"), (3, "good.com"), (4, "x.unlisted.com"),
         (5, "docs.google.com"), (6, "host.nosuffixhere"), (9, "mail.good.com")]
    a += [(10 + i, f"h{i}.good.com") for i in range(25)]
    list_a = spark.createDataFrame(a, io.RANKED_RAW)
    list_b = spark.createDataFrame([(1, "Good.com"), (2, "google.com"), (99, "unlisted.com")], io.RANKED_DOMAIN)
    stress = spark.createDataFrame([("mail.google.com",)], io.STRESS)
    data = ds.build_dataset(raw, list_a, list_b, stress, top_n=10)
    return data.rows.cache(), data.ledger


def test_dataset_rows(built):
    rows, _ = built
    got = {r.hostname: (r.label, r.source) for r in rows.collect()}
    assert got["a.evil.xyz"] == (1, "phiusiil")
    assert "both.com" not in got and "" not in got
    assert got["sub.good.com"] == (1, "phiusiil")  # phishing: not taken from the benign list
    benign = [h for h, (_, s) in got.items() if s == "umbrella"]
    assert len(benign) == 20 and "mail.good.com" in benign and "h18.good.com" in benign
    assert "x.unlisted.com" not in got and "docs.google.com" not in got and "good.com" not in got


def test_dataset_split(built):
    rows, _ = built
    assert ds.shared_domains(rows).count() == 0
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "test"}
    hosted = rows.where("registered_domain = 'github.io'").select("fold").distinct().count()
    assert hosted == 1


def test_ledger_agrees_with_rows(built):
    rows, ledger = built
    steps = {(r.part, r.step_no): r for r in ledger.collect()}
    assert steps["clean", 0].remaining == 109
    assert steps["clean", 1].removed == 1 and steps["clean", 2].removed == 1
    assert steps["clean", 3].removed == 1 and steps["clean", 4].removed == 2
    assert steps["benign", 0].remaining == 31
    assert [steps["benign", i].removed for i in range(1, 6)] == [2, 1, 1, 1, 6]
    assert steps["merge", 2].remaining == rows.count()


def char_wb(host):
    out = []
    for word in host.lower().split():
        w = f" {word} "
        for n in (3, 4, 5):
            out += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))] if len(w) >= n or n == 3 else []
    return out


def test_ngrams(spark):
    hosts = ["a", "ab", "abc.de", "", "x y", "Paypal-Login.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "hostname string")
    rows = df.select("hostname", F.expr(tr.ngram_sql()).alias("g")).collect()
    for r in rows:
        assert Counter(r.g) == Counter(char_wb(r.hostname)), r.hostname


def test_tfidf_vector(spark):
    hosts = ["aaaa.com", "bbb.com", "aaaa.net"]
    df = spark.createDataFrame([(h,) for h in hosts], "hostname string")
    model = tr.NgramModel.of(tr.ngram_vocabulary(df, min_df=1))
    row = model.vectors(df.where("hostname = 'aaaa.com'")).first()
    grams = Counter(char_wb("aaaa.com"))
    assert grams["aaa"] == 2
    want = {
        g: (1 + math.log(c)) * (math.log(4 / (1 + sum(g in char_wb(h) for h in hosts))) + 1)
        for g, c in grams.items()
    }
    norm = math.sqrt(sum(v * v for v in want.values()))
    got = {model.grams[i]: v for i, v in zip(row._unit.indices, row._unit.values)}
    assert got == pytest.approx({g: v / norm for g, v in want.items()})


@pytest.fixture(scope="module")
def champion(spark):
    bad = [(f"login-paypal{i}.xyz", f"login-paypal{i}.xyz", 1, i % 2) for i in range(60)]
    good = [(f"news.site{i}.com", f"site{i}.com", 0, i % 2) for i in range(60)]
    rows = spark.createDataFrame(bad + good, "hostname string, registered_domain string, label int, fold int")
    return tr.train_champion(with_features(rows).cache(), k=2, trees=2, depth=2, iterations=20)


def test_champion_separates_and_survives_saving(spark, champion, tmp_path):
    hosts = spark.createDataFrame([("login-paypal999.xyz",), ("news.other.com",)], "hostname string")
    p = {r.hostname: r.probability for r in champion.score(hosts).collect()}
    assert p["login-paypal999.xyz"] > 0.5 > p["news.other.com"]
    champion.save(spark, str(tmp_path / "m"))
    loaded = tr.Champion.load(spark, str(tmp_path / "m"))
    assert loaded.threshold == champion.threshold and loaded.feature_version == "v1.1"
    parity = metrics.score_parity(champion.score(hosts), loaded.score(hosts), "hostname").first()
    assert parity.max_abs_diff < 1e-9 and parity.unmatched == 0


REQUESTS = [
    ("1", "2024-01-01T10:00:00Z", "https://paypa1-verify.github.io/secret?k=1"),
    ("2", "2024-01-01T11:00:00Z", "https://login-paypal5.xyz/a"),
    ("3", "2024-01-02T10:00:00Z", "https://"),
    ("4", "2024-01-03T10:00:00Z", "news.site3.com"),
    ("2", "2024-01-01T11:30:00Z", "https://login-paypal5.xyz/a"),
]


def write_requests(spark, path):
    for i, row in enumerate(REQUESTS):  # one file each: several micro-batches
        df = spark.createDataFrame([row], "request_id string, timestamp string, url string")
        df.coalesce(1).write.mode("append").json(path)


def test_stream_equals_batch(spark, champion, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write_requests(spark, src)
    stream = st.read_requests(spark, src, files_per_batch=1)
    st.start_log(st.score_requests(stream, champion), out, cp).awaitTermination()
    key = ["request_id", "timestamp"]
    got = io.read_prediction_log(spark, out).orderBy(*key).collect()
    batch = st.score_requests(spark.read.schema(st.REQUESTS).json(src), champion)
    assert got == io.log_rows(batch).orderBy(*key).collect() and len(got) == 4
    text = "".join(r.value for r in spark.read.text(out).collect())
    assert "secret" not in text and "https://" not in text
    hosted = batch.where("request_id = '1'").first()
    assert hosted.signals[0] == "free hosting" and hosted.decision in ("safe", "review")
    assert hosted.signals == ["free hosting", "brand lookalike", "brand homoglyph", "suspicious keywords"]
    # A restart from the checkpoint reads nothing twice.
    st.start_log(st.score_requests(st.read_requests(spark, src), champion), out, cp).awaitTermination()
    assert io.read_prediction_log(spark, out).count() == 4
    bad = st.rejected(spark.read.schema(st.REQUESTS).json(src)).collect()
    assert [(r.request_id, r.reject_reason) for r in bad] == [("3", "no hostname")]


def test_stream_drops_repeats(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_requests(spark, src)
    once = st.drop_repeats(st.read_requests(spark, src))
    st.start_table(once, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "4"]


def test_request_ids(spark):
    df = spark.range(3).selectExpr("id", "'u' AS url")
    random_ids = [r.request_id for r in st.with_request_id(df).collect()]
    assert len(set(random_ids)) == 3 and all(len(i) == 32 for i in random_ids)
    a, b = (st.with_request_id(df, "id", "url").orderBy("id").collect() for _ in range(2))
    assert a == b and len({r.request_id for r in a}) == 3
