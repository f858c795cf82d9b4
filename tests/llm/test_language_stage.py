"""What the language stage keeps."""

from leasegrain.llm import langid

COLUMNS = "doc_id long, text string, lang string, score double"


def test_unclear_texts_go_and_own_columns_stay(spark):
    rows = [(k, ("the house and the garden were old " if k % 2 else "das haus und der garten waren alt ") * (1 + k % 3), "en" if k % 2 else "de", 0.25) for k in range(80)]
    odd = [(100, None, None, 0.5), (101, "", "en", 0.5), (102, "12 34 !!", "en", 0.5), (1, rows[1][1], "en", None)]
    docs = spark.createDataFrame(rows + odd, COLUMNS)
    judged = langid.identify(docs.drop("score")).collect()
    unclear = {r.doc_id for r in judged if r.ambiguous or r.lang_pred == "und"}
    got = langid.recognised(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text, r.score is None) for r in got.collect())
    assert kept == sorted((i, t, s is None) for i, t, _, s in rows + odd if i not in unclear)
    assert {100, 101, 102} <= unclear and len(kept) >= 80


def test_a_close_call_is_rejected(spark, monkeypatch):
    rows = [(k, ("the house and the garden were old " if k % 2 else "das haus und der garten waren alt "), "en" if k % 2 else "de", 0.25) for k in range(80)]
    docs = spark.createDataFrame(rows, COLUMNS)
    monkeypatch.setattr(langid, "sample", lambda part: [(t, lang) for _, t, lang, _ in rows])
    real = langid.fit

    def undecided(rows):
        model = real(rows)
        model.weights[:], model.bias[:] = 0, 0
        return model

    monkeypatch.setattr(langid, "fit", undecided)
    assert langid.recognised(docs).count() == 0


def test_without_labels_only_texts_without_a_letter_go(spark):
    docs = spark.createDataFrame([(1, "any words", None, 0.1), (2, "12", None, 0.1), (3, None, None, 0.1), (4, "Éa", None, 0.1)], COLUMNS)
    assert {r.doc_id for r in langid.recognised(docs).collect()} == {1, 4}
    assert langid.recognised(docs.where("false")).count() == 0
