import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import language as G

SAMPLES = [
    ("en", "the dog is in the house and we are going to the river with them"), ("en", "there was nothing near the old bridge"),
    ("de", "der Hund ist in dem Haus und wir gehen zum Fluss mit ihnen"), ("de", "da war nichts an der alten Brücke"),
    ("pl", "pies jest w domu i idziemy nad rzekę z nimi"), ("pl", "nic nie było przy starym moście"),
]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(12, 3)) * 4
    docs = sorted((rng.integers(0, 12, n) for n in (7, 5, 5, 2, 1)), key=len, reverse=True)
    for d, path in zip(docs, G.viterbi(docs, scores, 2.5)):
        value = lambda p: sum(scores[w, s] for w, s in zip(d, p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(value(path) - max(map(value, itertools.product(range(3), repeat=len(d))))) < 1e-9


def spans(text):
    model = G.Model(SAMPLES)
    scorer = G.Scorer(model)
    names = [*model.langs, "und"]
    return [[names[k] for k in path] for _, _, path in G.labelled([text], scorer)]


def test_spans_and_scripts():
    text = "the dog is in the house and we are going with them " + "der Hund ist in dem Haus und wir gehen mit ihnen zum Fluss"
    (path,) = spans(text)
    assert path[:12] == ["en"] * 12 and path[12:] == ["de"] * 13
    (path,) = spans("the dog is in the house это совсем другой язык вот здесь and we are going to the river")
    assert path[6:12] == ["und"] * 6 and path[0] == path[-1] == "en"
    assert spans("") == [] and spans("12 -- 34") == []


@pytest.mark.parametrize("label,want", [("en", ["en"]), ("en_GB", ["en"]), ("pt-BR", ["pt"]), ("ger", ["de"]), ("DEU", ["de"]), (" es-419 ", ["es"]), ("", []), (None, []), ("und", []), ("unknown", []), ("fr, en", ["en", "fr"]), ("ru", ["ru"])])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(G.named_languages(F.col("l")).alias("x")).first().x == want


def test_operator(spark, rows):
    model = G.fitted(spark.createDataFrame(SAMPLES, "lang string, text string"), "lang", "text")
    en, de = "the dog is in the house and we are going to the river with them. " * 3, "der Hund ist in dem Haus und wir gehen zum Fluss mit ihnen. " * 3
    data = [(1, "en-us", en), (2, "de", en), (3, None, de), (4, "en", en + de), (5, "de en", en + de), (6, "en", ""), (7, "en", None), (8, "en", en * 5 + "mit ihnen zum Fluss gehen wir"), (2, "de", en)]
    df = spark.createDataFrame([(*d, 0.5) for d in data], "doc_id bigint, lang string, text string, share double").repartition(3)
    langs = G.document_languages(df, "doc_id", "text", model, ["lang"])
    assert rows(G.wrong_labels(langs, "doc_id", "label")) == [(2, "en"), (3, "de"), (4, "de"), (4, "en")]
    assert all(0.5 < r.confidence <= 1 for r in langs.where("share > 0.2").collect())
    s = G.language_spans(df, "doc_id", "text", model).where("doc_id = 4").orderBy("span").collect()
    assert [(r.span, r.lang) for r in s] == [(0, "en"), (1, "de")]
    both = en + de
    assert both[s[1].char_start :].startswith("der Hund") and both[: s[0].char_end].endswith("them") and s[0].char_start == 0
    assert G.document_languages(df.limit(0), "doc_id", "text", model).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_held_out_accuracy(spark):
    samples = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").orderBy("sample_id").select("lang", "text").collect()]
    scorer = G.Scorer(G.Model(sorted(samples[::2])))
    test = samples[1::2]
    names = [*scorer.model.langs, "und"]
    right = sum(names[int(np.bincount(path).argmax())] == test[i][0] for i, _, path in G.labelled([t for _, t in test], scorer))
    assert right >= 0.99 * len(test)


def test_offsets_go_with_words():
    text = "1\n00:00:01,000 --> 00:00:02,000\n- <i>Der Hund</i> [BELLT]\n\n2\n00:00:03,000 --> 00:00:04,000\nfÃ¼r e\u0301t\u200be\nwww.x.example\n"
    words, at = G.words_of(text), G.word_offsets(text)
    assert words == ["der", "hund", "für", "éte"] and len(at) == 4
    assert [text[a:b].lower() for a, b in at[:2]] == words[:2]
