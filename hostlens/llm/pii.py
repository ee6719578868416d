"""Personal data: base patterns, and identifiers found by bootstrapped lexical contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import hex_of, lookup, text_or_empty
from hostlens.llm.spans import Kind, count_of, matches, overlaps, written
from hostlens.sources.scratch import durable

ROUNDS = 3
SUPPORT = 5  # known instances a pattern needs
CONFIDENT = 0.5  # least confidence of a pattern that discovers; one alone must reach ACCEPT
ACCEPT = 0.9  # least score of a discovered identifier

# The patterns and tests of the base kinds. Each is written so that it fails once per
# run of characters and not from every character of it; the matches are those of the plain form.
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.pmod(d.cast("int") * 2 - 1, F.lit(9)) + 1 - F.when(d == "0", 9).otherwise(0)
    ))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


BASE = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True),
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        lambda m: _digits(m).between(12, 19) & _luhn(m),
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")),
        lambda m: _digits(m).between(9, 15),
    ),
)
_FOUND = r"(?<!\S)(?=\S{5})(?=[^\s0-9@]*+[0-9@])\S*[A-Za-z0-9]"
#: Tokens that may be identifiers of unknown form.
FOUND = Kind("found", _FOUND, lambda t: t.rlike("[0-9@]"), lambda m: F.contains(m, F.lit("@")) | (_digits(m) >= 4))


def _words(side: Column) -> Column:
    shape = F.regexp_replace(F.lower(side), "[0-9]", "0")
    return F.filter(F.split(shape, r"[\s\p{Punct}]+"), lambda w: w != "")


def patterns(span: Column) -> Column:
    """Lexical patterns of a span: two words before, two after, one on either side."""
    left, right = _words(span["before"]), _words(span["after"])
    l1, l2 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    return F.filter(F.array(
        F.concat(F.lit("L "), l2, F.lit(" "), l1), F.concat(F.lit("R "), F.get(right, 0), F.lit(" "), F.get(right, 1)),
        F.concat(F.lit("B "), l1, F.lit(" "), F.get(right, 0)),
    ), lambda p: p.isNotNull())


def discover(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, score) of unseen instances from the pattern-instance graph (pattern, instance, seed).

    A pattern's confidence is the score that its n instances have in all (`known`), over n, times
    known / (known + 1) as a discount for few of them; an unseen instance's score is the chance that not
    all of its confident patterns are wrong. Seeds keep score 1, unseen instances start with 0, and
    each round takes the scores of the one before. Patterns need a `known` of SUPPORT and confidence
    CONFIDENT: five seeds confirm a pattern, and several unseen instances are held by the other
    patterns around them.
    """
    edges = durable(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scores = None
    for _ in range(rounds):
        now = edges if scores is None else edges.join(scores, "instance", "left")
        known = F.when(F.col("seed"), 1.0).otherwise(0.0 if scores is None else F.coalesce("score", F.lit(0.0)))
        confident = now.groupBy("pattern").agg(
            F.sum(known).alias("known"), F.count("*").alias("n"),
        ).select("pattern", "known", (F.col("known") / F.col("n") * F.col("known") / (F.col("known") + 1)).alias("confidence")).where(
            (F.col("known") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)
        )
        reached = lookup(edges.where(~F.col("seed")), durable(confident), "pattern", "inner")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = durable(reached.groupBy("instance").agg((1 - F.exp(doubt)).alias("score")))
    return scores


def extract(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT
) -> DataFrame:
    """(doc_id, base, found) per row: spans of the base kinds, and tokens apart from them that the
    contexts of the base kinds' values, scored over the whole corpus, show to be identifiers.

    NULL and empty texts have none; repeated rows each give a row but count once as evidence, since
    instances are distinct values; no rows give no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
    base = F.concat(*[matches(F.col("text"), k, i) for i, k in enumerate(BASE)])
    stored = durable(rows.select(
        "doc_id", base.alias("base"), matches(F.col("text"), FOUND, len(BASE)).alias("found")
    ).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "base",
        F.filter("found", lambda t: ~F.exists("base", lambda b: overlaps(b, t))).alias("found"),
    ))  # row numbers hold from here on
    spans = stored.select("row", F.explode(F.concat("base", "found")).alias("s")).select(
        "row", "s", F.sha2(F.lower("s.value"), 256).alias("instance"), (F.col("s.kind") != FOUND.name).alias("seed")
    )
    edges = spans.select("instance", "seed", F.explode(patterns(F.col("s"))).alias("pattern"))
    accepted = durable(discover(edges, rounds).where(F.col("score") >= accept))
    hits = lookup(spans.where(~F.col("seed")), accepted, "instance", "inner")
    by_row = hits.groupBy("row").agg(F.collect_list("s").alias("_found"))
    none = F.array().cast(stored.schema["found"].dataType)
    return stored.join(by_row, "row", "left").select("doc_id", "base", F.coalesce("_found", none).alias("found"))


def digest(extracted: DataFrame) -> DataFrame:
    """Counts and hashes of the spans of `extract`."""
    return extracted.select(
        "doc_id", *[count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE],
        hex_of(written(F.col("base"))).alias("base_sha256"), written(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
