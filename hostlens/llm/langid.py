"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostlens.llm.common import arrow_batches, give_back, text_or_empty

BUCKETS = 1 << 15
DIM = 16
LONGEST = 4  # letters of a subword
PER_LANGUAGE = 500  # labelled rows of each language that the model is fitted on, at most
SHORT = 8  # words of a short piece
CALIBRATION = 0.2
KEEP_RIGHT = 0.999  # share of right calibration predictions that rejection must keep
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(text: str) -> np.ndarray:
    """Bucket of every run of 1 to 4 symbols of the lower-cased text, where a run of non-letters is
    one boundary symbol; empty without a letter."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    seq = np.where(letter, codes, 0)[kept].astype(np.uint64)
    run, out = np.zeros(len(seq), np.uint64), []
    for n in range(LONGEST):
        if len(seq) <= n:
            break
        run = run[: len(seq) - n] * np.uint64(0x100000001B3) + seq[n:] + np.uint64(n + 1)
        out.append(((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # embedding times softmax weights, per bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, buckets: np.ndarray) -> np.ndarray:
        if len(buckets) > 4096:
            logits = np.bincount(buckets, minlength=BUCKETS) @ self.table
        else:
            logits = self.table[buckets].sum(0)
        logits = (logits / len(buckets) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected); a text without a letter is `und`, 0, rejected."""
        buckets = subwords(text or "")
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0, True
        p = self.probabilities(buckets)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _pieces(text: str) -> list[np.ndarray]:
    """The whole text, and four short pieces spread over it, so that short texts are learnt too."""
    words = text.split()
    parts = [text]
    if len(words) > 2 * SHORT:
        parts += [" ".join(words[i : i + SHORT]) for i in np.linspace(0, len(words) - SHORT, 4).astype(int)]
    return [b for b in map(subwords, parts) if len(b)]


def sample(docs: DataFrame, trained_on: Column, text: str, lang: str, doc_id: str, per_language: int) -> DataFrame:
    """(lang, order, packed bucket shares) of at most `per_language` labelled rows per language: those
    with the smallest hash of their text and id."""
    rows = docs.where(trained_on & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), text_or_empty(text).alias("text"),
        F.abs(F.xxhash64(text, F.col(doc_id).cast("string"))).alias("order"),
    )
    counts = rows.groupBy("lang").count()
    cut = (F.lit(float(2**63)) * (4.0 * per_language) / F.col("count")).alias("cut")
    few = rows.join(F.broadcast(counts.select("lang", cut)), "lang").where("order <= cut")  # a label set
    first = Window.partitionBy("lang").orderBy("order", "text")
    few = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)

    @F.pandas_udf("array<binary>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_packed(b) for b in _pieces(t)])

    return few.select("lang", "order", vectors("text").alias("vectors"))


def _packed(buckets: np.ndarray) -> bytes:
    at, n = np.unique(buckets, return_counts=True)
    return at.astype("<u2").tobytes() + (n / n.sum()).astype("<f4").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(data) // 6
    return np.frombuffer(data, "<u2", k).astype(np.int32), np.frombuffer(data, "<f4", k, 2 * k)


def fit(
    docs: DataFrame, trained_on: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    per_language: int = PER_LANGUAGE, epochs: int = 6, rate: float = 2.0, seed: int = 7,
) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows where `trained_on` holds.

    Stochastic gradient descent in numpy on mean bucket embeddings; a fifth of the sample is held
    back to fit the temperature and the rejection threshold: the largest calibrated probability that
    keeps 99.9% (`KEEP_RIGHT`) of the right predictions. Without labelled rows every text is `und`.
    """
    arrow_batches(docs.sparkSession)
    got = sample(docs, trained_on, text, lang, doc_id, per_language).toPandas().sort_values(["lang", "order"])
    names = sorted(set(got["lang"]))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    kept, held = [], []
    for k, (name, packed) in enumerate(zip(got["lang"], got["vectors"])):
        for v in packed:
            (held if k % round(1 / CALIBRATION) == 0 else kept).append((*_unpacked(v), names.index(name)))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    of = np.bincount([y for *_, y in kept or held], minlength=len(names))
    balance = of.sum() / (len(names) * np.maximum(of, 1))
    steps, step = epochs * max(len(kept), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            at, n, y = kept[i]
            hidden = n @ embed[at]
            p = np.exp((z := hidden @ weights + bias) - z.max())
            p /= p.sum()
            p[y] -= 1.0
            lr = rate * (1 - step / steps) * balance[y]
            back = weights @ p
            weights -= 0.1 * lr * np.outer(hidden, p)
            bias -= 0.01 * lr * p
            embed[at] -= np.outer(lr * n, back)
            step += 1
    model = LanguageModel(names, embed @ weights, bias)
    logits = np.array([n @ model.table[at] + bias for at, n, _ in held or kept])
    truth = np.array([y for *_, y in held or kept])

    def calibrated(t: float) -> np.ndarray:
        p = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    def loss(t: float) -> float:
        return -float(np.log(calibrated(t)[np.arange(len(truth)), truth] + 1e-12).mean())

    if len(truth):
        model.temperature = min(np.geomspace(0.05, 5, 60).tolist(), key=loss)
        p = calibrated(model.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == truth])
        if len(right):
            model.threshold = float(right[int((1 - KEEP_RIGHT) * len(right))])
    return model


def predictor(model: LanguageModel):
    """A column function of a text: struct (lang_pred, score, rejected)."""
    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])
        give_back()
        return found

    return predict


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row. NULL, empty and letterless texts: und, 0.0, true."""
    arrow_batches(docs.sparkSession)
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), predictor(model)(text_or_empty(text)).alias("p"))
    return found.select("doc_id", "p.lang_pred", "p.score", "p.rejected")


def in_training(doc_id: Column, folds: int = 5) -> Column:
    """Documents to learn from: crc32 of the id as text is no multiple of `folds`; not a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` without the rows whose language is rejected, its columns unchanged. NULL and empty texts and
    those without letters are rejected; repeated rows are judged alike; no rows give no rows."""
    arrow_batches(docs.sparkSession)
    return docs.where(~predictor(model)(text_or_empty(text))["rejected"])
