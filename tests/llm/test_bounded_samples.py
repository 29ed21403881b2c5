"""Samples for fitting are bounded, and no text is too long to be learned from."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skald.llm import op1_rule_ensemble as op1
from skald.llm import op6_toxicity_cnn as op6
from skald.llm import op10_cross_parsing as op10
from skald.llm.sampling import fitting_ids, one_row_each, sample_ids

SYLLABLES = {"en": "the and thing with ton ly", "fr": "que les eau tion ment oir", "de": "und sch ung eit ein ber"}


def _prose(rng, lang, letters):
    words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(letters // 6)]
    return " ".join(words)


@pytest.mark.parametrize("short", ["", "de"])
def test_op10_learns_from_long_texts(spark, short):
    rng = random.Random(3)
    rows = [(i, _prose(rng, lang, 600 if lang == short else 30_000), lang) for i in range(8) for lang in ("en", "fr", "de")]
    rows = [(3 * i + k, t, lang) for k, (i, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = op10.predict_language(docs, op10.learn_languages(docs)).join(docs, "doc_id")
    assert got.where("lang_pred <> lang").count() == 0 and got.count() == 24
    tight = op10.CrossParsing(reference_bytes=1_000)  # no text fits: the shortest of each language is taken
    assert op10.predict_language(docs, op10.learn_languages(docs, tight)).join(docs, "doc_id").where("lang_pred <> lang").count() == 0


def test_op6_learns_from_long_texts(spark):
    rng = random.Random(4)
    toxic = lambda i: i % 2
    texts = [_prose(rng, "en", 25_000) + (" vileword nastyword" * 20 if toxic(i) else "") for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic(i)) for i in range(40)], "doc_id long, toxic int")
    scored = op6.score_toxicity(docs, op6.learn_toxicity(docs, labels, op6.CnnConfig(epochs=10)))
    assert scored.where(F.col("predicted") != F.col("doc_id") % 2).count() == 0


def test_an_id_on_many_rows_is_one_row(spark):
    many = [(7, "x" * (k % 50 + 3), "en") for k in range(2_000)] + [(8, None, "en"), (9, "yy", None), (None, "z", "en")]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    assert one_row_each(docs, [7, 8], "doc_id", "text", ["text"]).orderBy("doc_id").collect() == [(7, "xxx"), (8, None)]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    model = op1.learn_quality(docs, labels)
    assert op1.score_quality(docs, model).count() == len(many)


def test_samples_fit_their_bounds(spark):
    docs = spark.createDataFrame([(i, "é" * (i + 1), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, c string")
    picked = sample_ids(docs, "doc_id", "c", 20)
    assert {c: len(ids) for c, ids in picked.items()} == {"a": 20, "b": 20}
    chosen = fitting_ids(docs, picked, "doc_id", "text", 15, 200, "c")
    for c, ids in chosen.items():
        assert 0 < len(ids) <= 15 and sum(2 * (i + 1) for i in ids) <= 200 and set(ids) <= set(picked[c])
        assert ids == [i for i in picked[c] if i in ids]  # in order of their hashes
    assert fitting_ids(docs, picked, "doc_id", "text", 15, 1, "c") == {c: [min(ids)] for c, ids in picked.items()}
    assert fitting_ids(docs, {}, "doc_id", "text", 15, 1) == {} and fitting_ids(docs, {"a": [999]}, "doc_id", "text", 5, 9) == {"a": []}


@pytest.mark.parametrize("letters", [26, 4_000])
def test_op10_automata_travel_as_their_transitions(letters):
    points = np.random.default_rng(5).integers(0x4E00, 0x4E00 + letters, 20_000)
    made = op10.Automaton(points)
    sent = pickle.dumps(made)
    assert len(sent) < 16 * len(made.cells) and len(sent) < (made.dense.nbytes if made.dense is not None else made.table.nbytes)
    back = pickle.loads(sent)
    text, off = np.append(points[3_000:3_400], -1), np.array([0, 401])
    assert back.phrases(text, off, 64).tolist() == made.phrases(text, off, 64).tolist() == [1]
