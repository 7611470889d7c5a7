from weirflow.llm import language_id


def test_a_small_language_keeps_its_script():
    rows = [("the thing would with " * 50, "en")] * 60 + [("nicht schön über der " * 50, "de")] * 60 + [("kakšna čaša žita", "sl")] + [("это слово когда", "ru")]
    model = language_id.learn(rows)
    latin, cyrillic = (language_id.SCRIPT_NAMES.index(s) for s in ("latin", "cyrillic"))
    assert model.languages == ["de", "en", "ru", "sl"]
    assert (model.scripts[latin] == 0).tolist() == [True, True, False, True]
    assert (model.scripts[cyrillic] == 0).tolist() == [False, False, True, False]
    lang, *_ = language_id.label_texts(model, language_id.Features(model.features), ["čaša žita kakšna", "schön nicht", "слово"])
    assert lang == ["sl", "de", "ru"]


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": (letters[k % 26] + letters[k // 26]) * 4 for k in range(150)}
    rows = [(f"{w} {w}{'x' * (k % 2)}", lang) for lang, w in words.items() for k in range(2 + (lang < "l100"))] + [("unlabelled", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample=4)
    assert model.languages == sorted(words)
    df = spark.createDataFrame([(lang, f"{w} {w} {w}") for lang, w in words.items()], "lang string, text string")
    got = language_id.predict(df, model).collect()
    assert all(r["lang_pred"] == r["lang"] and [s["lang"] for s in r["spans"]] == [r["lang"]] for r in got) and len(got) == 150
