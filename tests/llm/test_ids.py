"""Ids above 2^53 beside a null one in the same batch stay as they are in every operator, and so do ids of other types."""

from __future__ import annotations

import numpy as np
import pytest

from spoorline.llm import fim, lang_id, lm_score, near_copies, quality_mil, secret_scan, sentencepiece, simhash_dedup, toxicity

BIG = 2**53
IDS = [BIG + 1, BIG + 3, None, BIG + 5, BIG + 7]
TEXTS = ["one two three four five six seven", "the access key of the old house by the river", None, "one two three four five six seven", "another text of some plain words here"]


def scorer():
    return toxicity.fit(np.zeros((0, 1 + toxicity.FOLDS, len(toxicity.FEATURES))), np.zeros(0, dtype=np.int64), toxicity.Lexicon(), np.zeros(0, dtype=np.int64))


OPERATORS = {
    "secrets": lambda df: secret_scan.find_secrets(df),
    "pieces": lambda df: sentencepiece.encode_decode(df, sentencepiece.load(df.sparkSession)),
    "lm": lambda df: lm_score.score(df, {"the": 0}, lm_score.Network.new(), counts=lm_score.word_counts(df)),
    "toxicity": lambda df: toxicity.predict(df, scorer()),
    "language": lambda df: lang_id.predict(df, ["en", "de"], np.zeros((lang_id.BINS, 2), dtype=np.float32)),
    "quality": lambda df: quality_mil.classify(df, quality_mil.fit(np.zeros((0, quality_mil.WIDTH), dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))),
    "fim": lambda df: fim.fill_in_middle(df),
    "simhash": lambda df: simhash_dedup.near_duplicates(df),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_long_ids_beside_null(spark, name):
    df = spark.createDataFrame(list(zip(IDS, TEXTS, strict=True)), "doc_id long, text string").coalesce(1)
    out = OPERATORS[name](df)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(IDS, key=str) and out.schema["doc_id"].dataType == df.schema["doc_id"].dataType


def test_components_of_long_ids(spark):
    df = spark.createDataFrame(list(zip(IDS, TEXTS, strict=True)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == {BIG + 1: BIG + 1, BIG + 5: BIG + 1, BIG + 3: BIG + 3, BIG + 7: BIG + 7, None: None}


def test_copies_with_long_ids_go(spark):
    df = spark.createDataFrame(list(zip(IDS, TEXTS, strict=True)), "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id for r in near_copies.keep_first(df).collect()), key=str) == sorted([BIG + 1, BIG + 3, BIG + 7, None], key=str)


def test_text_ids(spark):
    df = spark.createDataFrame([("x/1", "a b c"), (None, "a b c"), ("é", None)], "doc_id string, text string").coalesce(1)
    assert {r.doc_id for r in secret_scan.find_secrets(df).collect()} == {"x/1", None, "é"}


def test_an_id_that_is_repeated_is_one_row_of_the_fit(spark):
    from pyspark.sql import functions as F

    from spoorline.llm.common import labelled_sample, one_text_an_id

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    sample = labelled_sample(labels, "doc_id", "toxic", F.lit(True), 10)
    assert sorted(map(tuple, one_text_an_id(docs, "doc_id", "text", sample).collect())) == [(1, "text 0", 1), (2, "b", 0), (3, "", 1)]


def test_languages_of_long_texts_go_by_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    words = [b"haus", b"garten", b"river", b"stone", b"night"]
    texts = [b" ".join(words[i] for i in rng.integers(0, 5, n)) for n in (0, 3, 400, 2500)] + [b"x" * 3000]
    logp = np.log(rng.random((lang_id.BINS, 3)) + 0.1).astype(np.float32)
    whole = lang_id.mixture(texts, logp)
    monkeypatch.setattr(lang_id, "BLOCK", 700)
    assert all(b"".join(lang_id._blocks(t, 700)) == t and max(map(len, lang_id._blocks(t, 700))) <= 1400 for t in texts)
    got = np.concatenate([lang_id.mixture([t], logp) for t in texts])
    assert np.abs(got - whole).max() < 0.05  # units begin anew with a block


@pytest.mark.parametrize("text", ["=" * 300_001, "▁" + "-=" * 150_000, "xyz" * 100_001, "a" * 5000 + "=" * 100_000 + "b" * 5000])
def test_texts_that_repeat_are_encoded_at_once(spark, text):
    import time

    import sentencepiece as library

    encoder = sentencepiece.Encoder(sentencepiece.load(spark))
    began = time.time()
    got = encoder.encode([text])[0]
    assert time.time() - began < 15
    assert got.tolist() == library.SentencePieceProcessor(model_file=sentencepiece.MODEL).encode(text)
