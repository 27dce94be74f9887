"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes accents, look-alike letters and digits put for letters. The lexicon holds whole words and word
beginnings with their log-odds, learnt from a bounded sample of labelled rows; seed words stand in where labels are
few. A hit inside an exception phrase does not count. The score is a logistic function of the summed weights over a
slowly growing function of the length.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mnemoria.llm.common import documents, hash_share, held_out, in_training, ship_package, stored, with_columns

# Look-alikes of Latin letters (Cyrillic, Greek, Turkish and signs), and digits or signs put for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ц": "u", "у": "y", "х": "x",
    "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Seed words (weight ``Settings.seed_weight`` until labels say otherwise) and harmless phrases.
SEEDS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
EXCEPTIONS = ["class clown", "clown fish", "pond scum", "sore loser", "stupid question", "trash bag", "trash can"]


@dataclass(frozen=True)
class Settings:
    #: About so many labelled rows of each class are learnt from, at most; bounds what reaches the driver.
    rows_per_class: int = 3000
    most_entries: int = 3000
    least_docs: int = 6
    #: Of the sampled toxic documents, the share that must hold an entry.
    least_share: float = 0.01
    least_weight: float = 3.0
    seed_weight: float = 4.0
    shortest: int = 4
    longest: int = 8
    seed: int = 11


@dataclass(frozen=True)
class Model:
    #: Pattern (" word " or " begi") -> weight.
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    offset: float


def _table() -> dict[int, str]:
    """One character to its folded form: letters lower-cased and unaccented, anything but letters to a space."""
    fixed = {**LOOK_ALIKES, **DIGITS, **{k.upper(): v for k, v in LOOK_ALIKES.items()}}
    return {ord(k): v for k, v in fixed.items() if len(k) == 1}


class Folding(dict):
    """A translation table filled as characters occur."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", char.lower()) if not unicodedata.combining(x))
        base = "".join(LOOK_ALIKES.get(x, x) for x in base)
        if unicodedata.combining(char) or unicodedata.category(char) == "Cf":
            self[code] = ""
        else:
            self[code] = base if base.isalpha() else " "
        return self[code]


FOLDING = Folding(_table())


def folded(text: str | None) -> str:
    """Lower-case letters in words with single spaces between and around. A token without any letter folds to nothing,
    so numbers do not become words."""
    if not text:
        return " "
    kept = [word for word in text.split() if not word.isascii() or any(map(str.isalpha, word))]
    return f" {' '.join(' '.join(kept).translate(FOLDING).split())} "


def features(text: str, settings: Settings) -> set[str]:
    """Candidate lexicon entries of a folded text: its words whole, and their beginnings."""
    found = set()
    for word in set(text.split()):
        if len(word) >= settings.shortest:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in range(settings.shortest, min(settings.longest, len(word) - 1) + 1))
    return found


class Matcher:
    """Sums the weights of the lexicon's hits: the longest entry at each word, none inside an exception phrase."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in model.lexicon.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in model.exceptions:
            pattern = folded(phrase)
            self.automaton.add_word(pattern, (len(pattern), None))
        self.automaton.make_automaton()

    def weight(self, text: str) -> tuple[float, int]:
        """Summed weight and number of hits in a folded text."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (length, weight) in self.automaton.iter(text):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                elif start not in best or length > best[start][0]:
                    best[start] = (length, weight)
        total, hits, at = 0.0, 0, 0
        for start in sorted(best):
            while at < len(spared) and spared[at][1] <= start:
                at += 1
            if any(a <= start < b for a, b in spared[at : at + 4]):
                continue
            total, hits = total + best[start][1], hits + 1
        return total, hits

    def density(self, text: str | None) -> tuple[float, int]:
        plain = folded(text)
        total, hits = self.weight(plain)
        return total / (1 + math.log1p(plain.count(" ") / 200)), hits

    def score(self, text: str | None) -> tuple[float, int]:
        value, hits = self.density(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.slope * value + self.model.offset)))), hits


def seeded(settings: Settings) -> Model:
    return Model({f" {folded(w).strip()} ": settings.seed_weight for w in SEEDS}, tuple(EXCEPTIONS), 1.5, -3.0)


def sketch(plain: str) -> int:
    """The smallest hash of a folded text's longer words; near copies mostly share it."""
    return min((zlib.crc32(w.encode()) for w in set(plain.split()) if len(w) > 3), default=0)


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled training rows: about ``rows_per_class`` of each class, by hash.

    The sampled labels, at most about twice that many (id, label) rows, are broadcast to the documents. Of rows with
    the same sketch one is kept, else the words of much-copied documents would pass for signs of their label.
    """
    marks = labels.where(in_training("doc_id") & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = [settings.rows_per_class / max(1, counts.get(label, 0)) for label in (0, 1)]
    chosen = marks.where(
        hash_share(F.col("doc_id"), F.lit(settings.seed)) < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("long")
    def sketched(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: sketch(folded(x))).astype("int64")

    return rows.groupBy(sketched("text").alias("sketch"), F.col("toxic").cast("int").alias("toxic")).agg(
        F.min_by("text", F.struct("doc_id", "text")).alias("text")
    )


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn the lexicon and the logistic curve; with too few labels of either class, the seed words stand."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = stored(sample(docs, labels, settings), "toxicity-sample")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found[toxic].update(features(folded(text), settings))
                found[toxic][""] += 1
            keys = sorted(set(found[0]) | set(found[1]))
            yield pd.DataFrame(
                {"entry": keys, "clean": [found[0][k] for k in keys], "toxic": [found[1][k] for k in keys]}
            )

    sums = rows.select("text", "toxic").mapInPandas(counted, "entry string, clean long, toxic long").groupBy(
        "entry"
    ).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(
        (F.col("entry") == "") | (F.col("toxic") >= settings.least_docs)
    )
    kept = sums.where(
        (F.col("entry") == "") | (F.col("toxic") > 4 * F.col("clean"))
    ).orderBy(F.col("entry") != "", F.desc("toxic"), "clean", "entry").limit(settings.most_entries).collect()
    base = seeded(settings)
    sizes = next((r for r in kept if r["entry"] == ""), None)
    if not sizes or min(sizes["clean"], sizes["toxic"]) < 4 * settings.least_docs:
        return base
    lexicon = dict(base.lexicon)
    least = max(settings.least_docs, settings.least_share * sizes["toxic"])
    for r in kept:
        odds = math.log((r["toxic"] + 0.5) / (sizes["toxic"] + 1)) - math.log((r["clean"] + 0.5) / (sizes["clean"] + 1))
        if r["entry"] and odds >= settings.least_weight and r["toxic"] >= least:
            lexicon[r["entry"]] = round(odds, 4)
        elif r["entry"]:
            lexicon.pop(r["entry"], None)
    return curve(rows, Model(lexicon, base.exceptions, base.slope, base.offset))


def curve(rows: DataFrame, model: Model) -> Model:
    """The logistic curve over the hit densities of the sampled rows (a number and a label of each go to the driver)."""

    def densities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for batch in batches:
            yield pd.DataFrame({"x": [matcher.density(t)[0] for t in batch["text"]], "y": batch["toxic"]})

    found = rows.select("text", "toxic").mapInPandas(densities, "x double, y int").collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], dtype=float)
    x1 = np.column_stack([x, np.ones_like(x)])
    weights = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    theta = np.array([model.slope, model.offset])
    ridge = np.diag([1.0, 1.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -30, 30)))
        slope = x1.T @ (weights * (y - p)) - ridge @ theta
        bend = (x1 * (weights * p * (1 - p))[:, None]).T @ x1 + ridge
        theta = theta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return Model(model.lexicon, model.exceptions, float(max(theta[0], 1e-3)), float(theta[1]))


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``n_hits``; null and empty texts have no hit. Same-named columns are replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # at most ``most_entries`` patterns

    @F.pandas_udf("score double, n_hits long")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pd.DataFrame([matcher.score(t) for t in texts], columns=["score", "n_hits"])

    found = docs.withColumn("__scored", scored(F.col(text)))
    return with_columns(found, score=F.col("__scored.score"), n_hits=F.col("__scored.n_hits")).drop("__scored")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        "n_hits",
    )
