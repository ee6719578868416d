"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import hex_of, lookup, text_or_empty
from hostlens.llm.spans import SPAN, Kind, count_of, matches, overlaps, written
from hostlens.sources.scratch import durable

COPIED_OWNERS = 3  # a value that so many owners have is a copied example

# The patterns and least lengths of the kinds.
_ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (
    Kind(
        "assign", _ASSIGN,
        lambda t: (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(_ASSIGN),
        lambda m: F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 6,
        lambda m: F.regexp_extract(m, _ASSIGN, 1),
    ),
    Kind("access", r"AKIA[A-Z0-9]+", lambda t: F.contains(t, F.lit("AKIA")), lambda m: F.length(m) >= 20),
    # A run of under 24 digits fails from each of its digits, so it need not match at all.
    Kind("hex", r"[0-9a-f]{24,}+", lambda t: t.rlike("[0-9a-f]{24}"), lambda m: F.length(m) >= 24),
)
_TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: What the method adds: unlabelled strings that look drawn at random.
TOKEN = Kind(
    "token", _TOKEN, lambda t: t.rlike(_TOKEN),
    lambda m: m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10),
)


def candidates(text: Column) -> tuple[Column, Column]:
    """(base spans, token spans that overlap none of them)."""
    base = F.concat(*[matches(text, k, i) for i, k in enumerate(BASE)])
    return base, matches(text, TOKEN, len(BASE))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_found) from (hash, owner, repo) rows: repositories are counted
    within owners. Combined before every shuffle; no step gathers a value's rows."""
    repos = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("n").alias("n_found")
    )


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
    copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """(doc_id, text_hash, base, findings) per row of `docs`.

    `base` are the spans of the base kinds; `findings` all spans, each with its value, the number of
    owners and repositories that have the value anywhere in the corpus, and its class: `copied` from
    `copied_owners` owners on, else `live`. Unlabelled tokens are findings if live or if the value is
    a base kind's somewhere. NULL and empty texts have none. A NULL owner (or repository) is one more
    owner. Repeated rows each give a row. No rows give no rows.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"),
        F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(f"`{repo}`").cast("string"), F.lit("")).alias("repo"),
    )
    base, tokens = candidates(F.col("text"))
    stored = durable(rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repo", base.alias("base"), tokens.alias("tokens"),
    ).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "owner", "repo", "base",
        F.filter("tokens", lambda t: ~F.exists("base", lambda b: overlaps(b, t))).alias("tokens"),
    ))  # row numbers hold from here on
    found = stored.select("row", "owner", "repo", F.explode(F.concat("base", "tokens")).alias("s")).select(
        "row", "owner", "repo", F.sha2(F.col("s.value"), 256).alias("hash"), "s"
    )
    usage = ownership(found).join(
        found.where(F.col("s.kind") != TOKEN.name).select("hash", F.lit(True).alias("named")).distinct(), "hash", "left"
    )
    each = lookup(found, durable(usage), "hash", "inner")
    copied = F.col("n_owners") >= copied_owners
    each = each.where((F.col("s.kind") != TOKEN.name) | ~copied | F.col("named")).select("row", F.struct(
        F.col("s.start"), F.col("s.rank"), F.col("s.end"), F.col("s.kind"), F.col("s.value"), "hash", "n_owners",
        "n_repos", F.when(copied, "copied").otherwise("live").alias("class"),
    ).alias("finding"))
    by_row = each.groupBy("row").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    none = F.array().cast(by_row.schema["findings"].dataType)
    return stored.join(by_row, "row", "left").select(
        "doc_id", "text_hash", "base", F.coalesce("findings", none).alias("findings")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and hashes of the spans of `scan`."""
    spans = F.col("findings")
    return scanned.select(
        "doc_id", *[count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE],
        hex_of(written(F.col("base"))).alias("base_sha256"), written(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["class"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["class"] == "copied")).cast("long").alias("n_copied"),
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the ordered spans cut out and a mask in place of each run of overlapping ones."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(
            s["start"] >= state["at"],
            F.array(text.substr(state["at"] + 1, s["start"] - state["at"]), F.lit(mask)),
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(
        s["out"], F.array(text.substr(s["at"] + 1, F.length(text)))
    ))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(done, ""))


def mask_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", n_chars: str = "n_chars",
    mask: str = "[SECRET]",
) -> DataFrame:
    """`docs` with live-looking secrets masked in their texts and `n_chars` (if there) to match; copied
    examples stay. All rows are kept, repeated ones too; a NULL text stays NULL, an empty one empty. No
    rows give no rows."""
    def key(of: Column, hash_of: Column) -> Column:
        return F.concat_ws(":", F.coalesce(of.cast("string"), F.lit("")), of.isNull(), hash_of)

    live = F.filter("findings", lambda s: s["class"] == "live")
    hits = scan(docs, doc_id, text, owner, doc_id).select(
        key(F.col("doc_id"), F.col("text_hash")).alias("key"), live.alias("live")
    ).where(F.size("live") > 0).select(
        "key", F.transform("live", lambda s: F.struct(s["start"], s["end"])).alias("live")
    ).dropDuplicates(["key"])
    columns = [F.col(f"`{c}`") for c in docs.columns]  # in a struct no name of theirs can clash
    keyed = docs.select(F.struct(*columns).alias("row"), key(F.col(f"`{doc_id}`"), F.xxhash64(text_or_empty(text))).alias("key"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = keyed.join(hits.hint("shuffle_hash"), "key", "left")
    new = masked(F.col("row")[text], F.coalesce("live", none), mask)
    out = found.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
    if n_chars not in docs.columns:
        return out
    size = F.coalesce(F.length(f"`{text}`").cast(docs.schema[n_chars].dataType), F.col(f"`{n_chars}`"))
    return out.withColumn(n_chars, size)


__all__ = ["BASE", "SPAN", "TOKEN", "digest", "mask_secrets", "ownership", "scan"]
