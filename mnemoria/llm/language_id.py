"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

The training sample is bounded by ``Settings.docs_per_language``; each sampled document is reduced to counts of
hashed subwords where it lies, so the driver receives a bounded number of bounded rows. The embeddings and the linear
layer are folded into one table (subword -> summed logits), which is all that scoring needs.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mnemoria.llm.common import documents, hash_share, held_out, in_training, ship_package, with_columns

_LETTERS = re.compile(r"[^\W\d_]+")
UNDECIDED = "und"
KEPT_WORDS = 200_000
PART = 10_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dim: int = 16
    shortest: int = 2
    longest: int = 4
    docs_per_language: int = 300
    least_docs: int = 5
    most_languages: int = 256
    piece_words: int = 6
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7
    #: Share of the calibration texts, rightly told, that the rejection threshold may lose, and its upper end.
    lost_share: float = 0.001
    highest_threshold: float = 0.4


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    #: (buckets, languages): embedding times linear layer.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def probabilities(self, total: np.ndarray) -> np.ndarray:
        """``total``: summed logits of all subwords, then their number."""
        return softmax((total[:-1] / total[-1] + self.bias) / self.temperature)


#: What a Python worker keeps from task to task, for the model it met last.
_KEPT: dict[str, "Known"] = {}


def known_words(model: Model) -> "Known":
    if model.name not in _KEPT:
        _KEPT.clear()
        _KEPT[model.name] = Known(model)
    return _KEPT[model.name]


class Known(dict):
    """Words seen, each the row of ``table`` with its summed logits and number of subwords."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.used = model, 0
        self.table = np.zeros((4096, len(model.languages) + 1))

    def add(self, words: list[str]) -> None:
        ids, sizes = subwords(words, self.model.settings)
        while self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rows = slice(self.used, self.used + len(words))
        self.table[rows, :-1] = np.add.reduceat(self.model.logits[ids], np.cumsum(sizes) - sizes, axis=0)
        self.table[rows, -1] = sizes
        self.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def told(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; ``und`` and 0 if the text is null or has no letter."""
        words = letter_words(text)
        if not words or not self.model.languages:
            return UNDECIDED, 0.0
        if self.used >= KEPT_WORDS:
            self.clear()
            self.used = 0
        rows = list(map(self.get, words))
        if None in rows:
            new = list(dict.fromkeys(w for w, row in zip(words, rows) if row is None))
            for at in range(0, len(new), PART):
                self.add(new[at : at + PART])
            rows = list(map(self.get, words))
        probs = self.model.probabilities(self.table[rows].sum(axis=0))
        best = int(np.argmax(probs))
        return self.model.languages[best], float(probs[best])


def letter_words(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it has no letter (signs such as raised digits are not letters)."""
    words = _LETTERS.findall(text.lower()) if text else []
    return words if any(any(map(str.isalpha, word)) for word in words) else []


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def subwords(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): hash buckets of each word's character n-grams and of the word, with marks at both ends, word by word."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[owner] - place
    factor = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(int(lengths.max()), factor, dtype=np.uint64))
    hashes = [np.add.reduceat(codes * powers[place], np.cumsum(lengths) - lengths)]
    owners = [np.arange(len(words))]
    for n in range(settings.shortest, settings.longest + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = h * factor + codes[at + k]
        hashes.append(h)
        owners.append(owner[at])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    ids = ((h >> np.uint64(32)) % np.uint64(settings.buckets)).astype(np.int64)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def examples(text: str | None, settings: Settings) -> Iterator[np.ndarray]:
    """Subword counts of the whole text, and of three short pieces of it so that short texts are learnt as well."""
    words = letter_words(text)
    if not words:
        return
    step = settings.piece_words
    starts = {0, len(words) // 2, max(0, len(words) - step)} if len(words) > step else set()
    for part in [words, *(words[s : s + step] for s in sorted(starts))]:
        counts = np.zeros(settings.buckets, dtype=np.float64)
        for at in range(0, len(part), PART):
            counts += np.bincount(subwords(part[at : at + PART], settings)[0], minlength=settings.buckets)
        yield counts.astype(np.float32)


def sampled(docs: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    """About ``docs_per_language`` labelled training rows of each language, chosen by hash, and the languages."""
    rows = docs.where(in_training("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = (
        rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= settings.least_docs)
        .orderBy(F.desc("n"), "lang").limit(settings.most_languages).collect()
    )
    if not counts:
        return rows.limit(0), []
    shares = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], settings.docs_per_language / row["n"])])
    chosen = rows.where(hash_share(F.col("doc_id"), F.lit(settings.seed)) < F.element_at(shares, F.col("lang")))
    return chosen, sorted(row["lang"] for row in counts)


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``docs`` (doc_id, text, lang). Without labelled rows the model has no languages and answers ``und``."""
    ship_package(docs.sparkSession)
    chosen, languages = sampled(docs, settings)
    if not languages:
        return Model(settings, [], np.zeros((settings.buckets, 0)), np.zeros(0))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                for counts in examples(text, settings):
                    ids = np.flatnonzero(counts)
                    found.append((int(doc_id), lang, ids.astype(np.int32).tobytes(), counts[ids].tobytes()))
            yield pd.DataFrame(found, columns=["doc_id", "lang", "ids", "counts"])

    rows = chosen.select("doc_id", "text", "lang").mapInPandas(
        reduced, "doc_id long, lang string, ids binary, counts binary"
    ).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], len(r["ids"])))
    index = {lang: i for i, lang in enumerate(languages)}
    data = [
        (r["doc_id"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32), index[r["lang"]])
        for r in rows
    ]
    fitted = [d[1:] for d in data if d[0] % 5]
    return calibrated(fit(fitted or [d[1:] for d in data], languages, settings), [d[1:] for d in data if not d[0] % 5])


def fit(data: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], settings: Settings) -> Model:
    rng = np.random.default_rng(settings.seed)
    embed = rng.uniform(-1, 1, (settings.buckets, settings.dim)) / settings.dim
    linear = np.zeros((settings.dim, len(languages)))
    bias = np.zeros(len(languages))
    steps = max(1, settings.epochs * len(data))
    for step in range(steps):
        ids, counts, label = data[rng.integers(len(data))]
        rate = settings.rate * (1 - step / steps)
        share = counts / counts.sum()
        mean = share @ embed[ids]
        error = softmax(mean @ linear + bias)
        error[label] -= 1
        back = linear @ error
        linear -= rate * np.outer(mean, error)
        bias -= 0.1 * rate * error
        # Averaging shrinks a bucket's gradient by its share; the usual remedy is a larger step for the embeddings.
        embed[ids] -= rate * 20 * np.outer(share, back)
    return Model(settings, languages, embed @ linear, bias)


def calibrated(model: Model, data: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Set the temperature by the likelihood of texts kept out of the fit, and the threshold for rejection."""
    if not data:
        return model
    raw = np.array([(c / c.sum()) @ model.logits[i] + model.bias for i, c, _ in data])
    labels = np.array([label for *_, label in data])
    at = np.arange(len(labels))
    losses = {t: -np.log(softmax(raw / t)[at, labels] + 1e-12).mean() for t in np.geomspace(0.05, 20, 61)}
    model.temperature = float(min(losses, key=losses.get))
    probs = softmax(raw / model.temperature)
    right = probs.max(axis=1)[probs.argmax(axis=1) == labels]
    if len(right):
        model.threshold = float(min(model.settings.highest_threshold, np.quantile(right, model.settings.lost_share)))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    Null, empty and letterless texts are ``und`` with score 0 and rejected; other texts are rejected if their
    score is below the model's threshold. Input columns of these names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = known_words(shared.value)
        for texts in batches:
            yield pd.DataFrame([known.told(x) for x in texts], columns=["lang_pred", "score"])

    found = docs.withColumn("__told", told(F.col(text)))
    rejected = (F.col("__told.lang_pred") == UNDECIDED) | (F.col("__told.score") < model.threshold)
    return with_columns(
        found, lang_pred=F.col("__told.lang_pred"), score=F.col("__told.score"), rejected=rejected
    ).drop("__told")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
