"""Token counts against the library; language and toxicity models on held-out rows and odd input."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemoria.llm import language_id, token_counts, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
ODD = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "ｆ", "😀", "\x00", "\x01", ".", "...", "!!", "can't", "0", "12",
       "</s>", "<0x41>", "ing", "Ä", "　", "́", "-", "x"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def test_counts_equal_the_library(library):
    own, rng = token_counts.counts(token_counts.default_model()), random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))
        assert own.of(text) == len(library.encode(text)), repr(text)
    assert own.of("ab" * 30000) == len(library.encode("ab" * 30000))


def test_generations_bound_the_memory(library, monkeypatch):
    monkeypatch.setattr(token_counts, "GENERATION", 5)
    own = token_counts.Counts(token_counts.Vocabulary(token_counts.default_model()))
    text = " ".join(f"word{i % 17}, again" for i in range(200))
    assert own.of(text) == len(library.encode(text))
    assert len(own) + len(own.older) <= 12


@needs_data
def test_op2_over_the_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in token_counts.op2_token_counts(spark, SF).collect():
        want = len(library.encode(texts[r.doc_id] or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 4096)


def test_op2_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, "  "), (4, "a b"), (4, "a b"), (None, "x")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.op2_token_counts(spark, table(rows)).collect())
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 2, 1), (4, 3, 2), (4, 3, 2)]
    assert token_counts.op2_token_counts(spark, table([])).count() == 0
    clash = spark.createDataFrame([("q", "a b", 9)], "N_TOKENS string, text string, keep int")
    out = token_counts.count_tokens(clash)
    assert out.columns == ["text", "keep", "n_tokens"] and out.first().n_tokens == 2


@needs_data
def test_language_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    told = language_id.op10_language_id(spark, SF).join(truth, "doc_id").where("held_out")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd_rows(spark, table):
    rows = [(i, "the cat and the dog were here" if i % 2 else "der hund und die katze", "en" if i % 2 else "de")
            for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !! ² Ⅷ", "de"), (None, "the cat", "en"), (1, rows[1][1], "en")]
    out = {r.doc_id: r for r in language_id.op10_language_id(spark, table(rows + odd)).collect()}
    assert len(out) == 64
    for i in (100, 101, 102):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[None].lang_pred == "en" and out[None].held_out is False
    assert all(out[i].lang_pred == rows[i][2] for i in range(60))
    assert language_id.op10_language_id(spark, table([])).count() == 0
    unlabelled = language_id.op10_language_id(spark, table([(1, "some text")])).first()
    assert (unlabelled.lang_pred, unlabelled.rejected) == ("und", True)


def test_subwords_of_many_words_are_those_of_each():
    settings, words = language_id.Settings(), ["a", "the", "straße", "x" * 70000, "日本語", "the"]
    ids, sizes = language_id.subwords(words, settings)
    at = 0
    for word, size in zip(words, sizes):
        own, (alone,) = language_id.subwords([word], settings)
        assert size == alone == 1 + sum(max(0, len(word) + 2 - n + 1) for n in (2, 3, 4))
        assert sorted(ids[at : at + size]) == sorted(own)
        at += size
    assert at == len(ids)


def test_folding_and_exceptions():
    matcher = toxicity.Matcher(toxicity.seeded(toxicity.Settings()))
    assert matcher.density("an 1d10t, a Sтυpіd one")[1] == 2
    assert matcher.density("put it in the trash can, then pond scum")[1] == 0
    assert matcher.density("trash, trash can")[1] == 1
    assert matcher.density("number 1234 55 idiots of idiotic clowns")[1] == 0
    assert matcher.density(None) == (0.0, 0) and matcher.density("") == (0.0, 0)
    assert matcher.score("idiot " * 3)[0] > matcher.score("idiot " * 3 + "calm words here " * 500)[0]


@needs_data
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = toxicity.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    right = told.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.93


def test_toxicity_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, "you idiot moron scum loser"), (3, "you idiot moron scum loser"), (None, "calm")]
    folder = table(rows)
    table([(1, None, None), (None, 1, 1), (3, 1, 1)], "labels", "doc_id LONG, quality INT, toxic INT", folder)
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, folder).collect()}
    assert got[3].predicted == 1 and got[1].predicted == got[2].predicted == got[None].predicted == 0
    empty = table([])
    table([], "labels", "doc_id LONG, quality INT, toxic INT", empty)
    assert toxicity.op9_toxicity(spark, empty).count() == 0
