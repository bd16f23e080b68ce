import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import languages as L

#: Sentences written for this test.
SAMPLES = {
    "en": "the report that you sent is missing the table which we need before the meeting on thursday and nobody knows why",
    "de": "der bericht den du geschickt hast enthält leider nicht die tabelle die wir vor der sitzung am donnerstag noch brauchen",
    "fr": "le rapport que tu as envoyé ne contient pas le tableau dont nous avons besoin avant la réunion de jeudi prochain",
    "es": "el informe que enviaste no contiene la tabla que necesitamos antes de la reunión del jueves y nadie sabe por qué",
    "pt": "o relatório que você enviou não contém a tabela de que precisamos antes da reunião de quinta e ninguém sabe por quê",
    "it": "la relazione che hai mandato non contiene la tabella di cui abbiamo bisogno prima della riunione di giovedì e nessuno sa perché",
    "nl": "het verslag dat je stuurde bevat niet de tabel die wij nodig hebben voor de vergadering van donderdag en niemand weet waarom",
    "pl": "raport który wysłałeś nie zawiera tabeli której potrzebujemy przed spotkaniem w czwartek i nikt nie wie dlaczego tak jest",
    "ru": "отчёт который ты прислал не содержит таблицы которая нужна нам до встречи в четверг и никто не знает почему так вышло",
}


def docs(n=240, wrong=0.1, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = L.NAMES[i % 9]
        ws = SAMPLES[lang].split()
        text = " ".join(rng.permutation(ws))
        label = str(rng.choice(L.NAMES)) if rng.random() < wrong else lang
        out.append((i, f"Subject: x\n\n{text}", label, lang))
    return out


def test_labels(spark):
    cases = {"en": "en", " EN-us ": "en", "English": "en", "ger": "de", "pt_BR": "pt", "DUTCH": "nl", "unknown": None, "": None, "?": None, "xx": None, None: None, "sv": None, "fra ": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert [r[0] for r in df.select(L.label_language(F.col("l"))).collect()] == list(cases.values())


@pytest.fixture(scope="module")
def model(spark):
    return L.trained(spark.createDataFrame(docs(), "doc_id bigint, text string, lang string, truth string"), sample_documents=200)


def test_wrong_labels_are_outvoted_and_mixed_documents_found(spark, model):
    data = [(i, t, label, truth) for i, t, label, truth in docs(90, 0.3, 7)]
    data.append((900, f"a: b\n\n{SAMPLES['en']}\n\n> {SAMPLES['ru']}\n\nshort one", "en-GB", ""))
    data += [(901, None, "en", ""), (902, "", None, ""), (None, "a: b\n\n" + SAMPLES["en"], "en", "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, confidence string")
    passages = L.passage_languages(df, model)
    got = {(r["doc_id"], r["lang"]) for r in passages.collect()}
    want = {(i, truth) for i, _, _, truth in data[:90]} | {(900, "en"), (900, "ru")}
    assert len(got & want) >= 0.98 * len(want) and len(got) <= len(want) + 2
    assert all(0 < r["confidence"] <= 1 for r in passages.collect())
    found = {tuple(r) for r in L.unlabelled_languages(passages).collect()}
    assert (900, "ru") in found and (900, "en") not in found
    assert {d for d, _ in found if d < 900} == {i for i, _, label, truth in data[:90] if label != truth}
    per = {(r["doc_id"], r["lang"]): r for r in L.document_languages(passages).collect()}
    assert abs(sum(r["share"] for (d, _), r in per.items() if d == 900) - 1) < 1e-9


def test_empty_tables(spark, model):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.passage_languages(df, model).count() == 0
    blank = L.trained(df)
    assert L.passage_languages(spark.createDataFrame([(1, "a: b\n\n" + SAMPLES["en"], None)], "doc_id bigint, text string, lang string"), blank).count() == 1


def test_scorer_equals_plain_features(model):
    ws = SAMPLES["it"].split() + ["k4011", "123"]
    p = L.Scorer(model).probabilities([ws, ["x"]])[0]
    (i, c) = L._features([ws])[0]
    v = c * model.idf[i]
    logits = model.scale * v / v.sum() @ model.weights[i] + model.bias
    assert np.allclose(p, L.softmax(logits[None] / model.temperature)[0])


def test_segments_of_a_mixed_passage(spark, model):
    en, ru, de = (SAMPLES[k].split() for k in ("en", "ru", "de"))
    text = "a: b\n\n" + " ".join([*en, *ru[:8], *en]) + "\n\n" + " ".join(de)
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (None, text, "z")], "doc_id bigint, text string, segment string")
    got = sorted(tuple(r) for r in L.passage_segments(df, model).collect())
    assert [(g[1], g[2], g[5]) for g in got] == [(0, 0, "en"), (0, 1, "ru"), (0, 2, "en"), (1, 0, "de")]
    assert sum(g[4] for g in got if g[1] == 0) == 2 * len(en) + 8 and abs(got[1][3] - len(en)) <= 2 and abs(got[1][4] - 8) <= 3
    assert L.Scorer(model).segments(["1", "2", "3"])[0][:2] == (0, 3)


def test_sample_follows_the_labelled_documents(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(L, "fit", lambda passages, labels, *rest, **more: fitted.append([L.NAMES[y] for y in labels]))
    rows = [(i, "a: b\n\n" + SAMPLES["en"], ("pl" if i % 1000 == 0 else "en") if i % 50 == 0 else "?") for i in range(10000)]
    L.trained(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_documents=100)
    assert len(fitted[0]) == 100 and fitted[0].count("pl") == 10  # of 200 labelled documents, all of the rare language
    L.trained(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_documents=300)
    assert len(fitted[1]) == 200


def test_quotas():
    assert L.quotas({"en": 10**10, "pl": 5, "de": 10**9}, 60) == {"en": 46, "pl": 5, "de": 9}
    assert L.quotas({"en": 7, "pl": 2}, 60) == {"en": 7, "pl": 2} and L.quotas({}, 60) == {}
    assert sum(L.quotas({k: 1000 + i for i, k in enumerate(L.NAMES)}, 1500).values()) == 1500


def test_idf_is_that_of_all_documents(spark):
    rows = [(i, "a: b\n\n" + SAMPLES["en"], "en") for i in range(40)] + [(100 + i, "a: b\n\n" + SAMPLES["ru"] + "\n\n" + SAMPLES["ru"], None) for i in range(30)] + [(None, None, None)]
    got = L.trained(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_documents=10).idf
    for word, n in (("report", 40), ("отчёт", 60)):
        assert np.allclose(got[L._grams(word)[-1]], np.log(101 / (1 + n)) + 1)
    assert np.allclose(L.corpus_idf(spark.createDataFrame([], "text string")), 1.0)


def test_every_message_has_a_language(spark, model, monkeypatch, tmp_path):
    from strandline.llm import queries

    monkeypatch.setattr(L, "trained", lambda docs: model)
    texts = ["a: b\n\n" + SAMPLES["en"] + "\n\nder bericht enthält leider nicht die tabelle", "a: b\n\nthe report is missing the table", "a: b\n\n-- \nthe report 1 2 3 4", "a: b\n\n12 34", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["passage"]): (r["n_words"], r["lang"]) for r in queries.p10_passages(spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (2, 0)} and got[0, 1] == (7, "de") and got[1, 0] == (6, "en")
    assert {r["doc_id"] for r in queries.p10_documents(spark, str(tmp_path)).collect()} == {0, 1, 2} == {r["doc_id"] for r in queries.p10_segments(spark, str(tmp_path)).collect()}
    assert queries.p10_found(spark, str(tmp_path)).count() == 0  # its paragraphs have 12 words
