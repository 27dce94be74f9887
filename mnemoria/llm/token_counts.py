"""Token counts by byte-pair merging with a heap and a linked list; no token is ever emitted.

The vocabulary and the merge order are read from a public sentencepiece file. A text is cut where no
vocabulary piece can span the cut, so every part merges on its own, and parts seen before are looked up.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mnemoria.llm.common import documents, ship_package, text_or_empty, with_columns

MARK = "▁"
RAW = "\x01"
GENERATION = 400_000
LONGEST_KEPT = 64
OVER = 4096
_PARTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_TAIL = re.compile(r"^([^\W\d_]+)([^\w].*)$", re.DOTALL)


class Vocabulary:
    """Merge ranks of a byte-pair model with byte fallback (rank 0 merges first; equal scores share a rank)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        longer = [piece for piece in self.ranks if len(piece) > 1]
        bounds = {pair for piece in longer for pair in zip(piece, piece[1:])}
        if any((b == MARK and a != MARK) or "\n" in (a, b) for a, b in bounds):
            raise ValueError("pieces span a space or a line end; parts would not be independent")
        self.letters_end_parts = not any(a.isalpha() and not b.isalpha() for a, b in bounds)

    def merged(self, part: str) -> int:
        """Tokens of one part: its symbols, less the merges, plus the extra bytes of unknown characters."""
        ranks, size = self.ranks, len(part)
        length = [1] * size
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        extra = [0 if char in ranks else len(char.encode("utf-8", "surrogatepass")) - 1 for char in part]
        heap = [(rank, i, i + 1, 2) for i in range(size - 1) if (rank := ranks.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, right, span = heapq.heappop(heap)
            if not length[left] or not length[right] or length[left] + length[right] != span:
                continue
            merges += 1
            length[left], length[right] = span, 0
            extra[left] = extra[right] = 0
            follow = after[left] = after[right]
            if follow < size:
                before[follow] = left
                joint = span + length[follow]
                if (rank := ranks.get(part[left : left + joint])) is not None:
                    heapq.heappush(heap, (rank, left, follow, joint))
            ahead = before[left]
            if ahead >= 0:
                joint = length[ahead] + span
                if (rank := ranks.get(part[ahead : ahead + joint])) is not None:
                    heapq.heappush(heap, (rank, ahead, left, joint))
        return size - merges + sum(extra)


class Counts(dict):
    """Counts of parts, in two generations so that memory stays bounded and frequent parts stay.

    A key stands for the part after one space mark; with ``RAW`` in front, for the part as it is.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        count = self.older.get(key)
        if count is None:
            tail = _TAIL.match(key) if self.vocabulary.letters_end_parts else None
            if tail:
                count = self[tail[1]] + self[RAW + tail[2]]
            elif key.startswith(RAW):
                lines = key[1:].split("\n")
                count = len(lines) - 1 + sum(self.vocabulary.merged(x) for x in lines if x)
            else:
                lines = (MARK + key).split("\n")
                count = len(lines) - 1 + sum(self.vocabulary.merged(x) for x in lines if x)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= GENERATION:
                self.older = dict(self)
                self.clear()
            self[key] = count
        return count

    def of(self, text: str | None) -> int:
        """Tokens of a whole text, with the leading space mark that the library puts first."""
        if not text:
            return 0
        if "  " in text or text[0] == " " or MARK in text or RAW in text:
            vocabulary, total = self.vocabulary, 0
            for part in _PARTS.findall(MARK + text.replace(" ", MARK)):
                if part == "\n":
                    total += 1
                elif part[0] == MARK and RAW not in part:
                    total += self[part[1:]]
                else:
                    total += vocabulary.merged(part)
            return total
        return sum(map(self.__getitem__, text.replace("\n", f" {RAW}\n").split(" ")))


@functools.lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(Vocabulary(path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out``: the tokens of ``text`` (null or empty: 0), no special tokens, nothing truncated.

    ``model`` is a sentencepiece byte-pair file with byte fallback, identity normalisation and a leading space mark,
    at the same path on every worker. An input column named as ``out`` is replaced.
    """
    ship_package(docs.sparkSession)
    path = model or default_model()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = counts(path)
        for texts in batches:
            yield pd.Series([known.of(x) for x in texts], dtype="int64")

    return with_columns(docs, **{out: tokens(F.col(text))})


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(rows).select(
        "doc_id",
        F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > OVER).alias("over_limit"),
    )
