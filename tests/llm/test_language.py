import numpy as np
import pytest

from sessionlake.llm.language import passage_segments, Tagger, _plain, blocks, document_languages, forward_backward, label_code, passages, train, train_from, unlabelled_languages

SAMPLES = [
    ("en", "The session continues where the earlier one stopped. We should read the log before we change anything."),
    ("en", "Nobody noticed that the queue was sorted by name. The tests pass on my machine and then fail on the server."),
    ("de", "Die Sitzung wird dort fortgesetzt, wo die frühere aufgehört hat. Wir sollten zuerst das Protokoll lesen."),
    ("de", "Niemand hat bemerkt, dass die Warteschlange nach Namen sortiert war. Die Tests laufen auf meinem Rechner durch."),
    ("fr", "La session continue là où la précédente s'est arrêtée. Il faudrait lire le journal avant de changer quelque chose."),
    ("fr", "Personne n'avait remarqué que la file était triée par nom. Les tests passent chez moi mais échouent sur le serveur."),
    ("ru", "Сессия продолжается там, где остановилась прежняя. Сначала нужно прочитать журнал."),
    ("ja", "前のセッションの続きから始めます。変更する前に記録を読んでください。"),
]


@pytest.fixture(scope="module")
def crf():
    return train(SAMPLES)


def test_forward_backward_agrees_with_enumeration():
    rng = np.random.default_rng(0)
    k, t = 3, 4
    e, a, s = rng.random((1, t, k)) + 0.1, rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    total, marginal, edges = 0.0, np.zeros((t, k)), np.zeros((k, k))
    for path in np.ndindex(*(k,) * t):
        w = s[path[0]] * np.prod([e[0, i, y] for i, y in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
        total += w
        for i, y in enumerate(path):
            marginal[i, y] += w
        for x, y in zip(path, path[1:]):
            edges[x, y] += w
    got, expected, log_z = forward_backward(e, a, s, np.array([t]), edges=True)
    assert np.allclose(got[0], marginal / total) and np.allclose(expected, edges / total) and np.isclose(log_z[0], np.log(total))
    padded = np.concatenate([e, np.ones((1, 2, k))], axis=1)
    again, more, z = forward_backward(padded, a, s, np.array([t]), edges=True)
    assert np.allclose(again[0, :t], marginal / total) and np.allclose(more, edges / total) and np.isclose(z[0], np.log(total))


def test_held_out_sentences(crf):
    tagger = Tagger(crf)
    held = [("en", "The server was slow before the change."), ("de", "Der Rechner war vor dem Wechsel langsam und die Sitzung brach ab."), ("fr", "Le serveur était lent avant la session précédente."), ("ru", "Сервер прочитал журнал."), ("ja", "記録を読んでから始めます。")]
    for version in (str, _plain, str.upper):
        told = tagger.languages_of([tagger.numbers(version(t).split()) for _, t in held])
        assert [x[0] for x in told] == [lang for lang, _ in held]


def test_segments_of_mixed_text(crf):
    words = "we should read the log wir sollten zuerst das protokoll lesen".split()
    parts = Tagger(crf).segments(words)
    assert [p[2] for p in parts] == ["en", "de"] and parts[0][0] == 0 and abs(parts[0][1] - 5) <= 1 and parts[-1][1] == len(words)


def test_blocks():
    text = "# Titel\n\nEin Absatz\nmit zwei Zeilen.\r\n\r\n> quoted\n> words\n\n- one\n- two\n\n```\ncode here\n\nmore\n```\n\n| a | b |\n|---|---|\n\n2026-05-02T11:19:59Z INFO x\n\n    indented code\n"
    assert [" ".join(b) for b in blocks(text)] == ["Ein Absatz mit zwei Zeilen.", "quoted words", "one two"]


@pytest.mark.parametrize("label,code", [("en", "en"), ("EN-us", "en"), ("en_GB", "en"), ("deu", "de"), ("German", "de"), ("ja-JP", "ja"), ("", None), (" ", None), (None, None), ("und", None), ("unknown", None), ("??", None), ("fra", "fr")])
def test_labels(label, code):
    assert label_code(label) == code


SCHEMA = "doc_id long, text string, lang string, passage_no string, _text string"


def test_rows(spark, crf):
    german = "Die Sitzung wird dort fortgesetzt, wo die frühere aufgehört hat."
    english = "The session continues where the earlier one stopped."
    rows = [
        (1, english, "en", "x", "y"), (2, german, "en", None, None), (3, f"{english}\n\n{german}", "English", None, None), (4, None, "de", None, None), (5, "", None, None, None), (6, "LGTM", "en", None, None),
        (7, english, None, None, None), (7, english, None, None, None), (8, f"{english} The user wrote \"{german[:30]}\" there.", "en-US", None, None), (9, "\n\n".join([english] * 3000), "de", None, None), (None, german, "de", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["lang"]) for r in unlabelled_languages(df, "doc_id", "text", "lang", crf).collect())
    assert got == [(2, "de"), (3, "de"), (7, "en"), (7, "en"), (9, "en")]
    found = passages(df, "doc_id", "text", crf)
    main = {r["doc_id"]: (r["lang"], r["n_passages"]) for r in document_languages(found, "doc_id").collect()}
    assert main[9] == ("en", 3000) and main[2] == ("de", 1) and 4 not in main and 6 not in main and main[None] == ("de", 1)
    assert all(0 <= r["confidence"] <= 1 for r in found.collect())
    assert passages(df.limit(0), "doc_id", "text", crf).count() == 0


def test_without_samples(spark):
    none = train_from(spark.createDataFrame([(None, "x"), ("en", None), ("en", "  ")], "lang string, text string"))
    df = spark.createDataFrame([(1, "some words of a text that is long enough", "en", None, None)], SCHEMA)
    assert passages(df, "doc_id", "text", none).count() == 0 and unlabelled_languages(df, "doc_id", "text", "lang", none).count() == 0


def test_segments_within_a_passage(spark):
    english = "The queue was drained before the worker could take the next job from the list"
    german = "Der Speicher wurde erst danach geleert und niemand hat den Fehler sofort bemerkt"
    rows = [(1, f"{english}. {german}. {english}.", "en", None, None), (2, f"{english}.\n\n{german}.", "en", None, None), (3, None, "en", None, None), (4, "", "en", None, None), (5, "two words", "en", None, None), (1, f"{english}. {german}. {english}.", "en", None, None)]
    field = train_from(spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet"))
    got = {}
    for r in passage_segments(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", field).orderBy("doc_id", "passage_no", "segment_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {1, 2} and len(got[1]) == 6
    assert [r["lang"] for r in got[1]] == ["en", "en", "de", "de", "en", "en"] and [(r["passage_no"], r["lang"]) for r in got[2]] == [(1, "en"), (2, "de")]
    assert " ".join(r["segment_text"] for r in got[1][::2]) == rows[0][1] and all(0 < r["confidence"] <= 1 for r in got[1])
    assert abs(got[1][2]["word_start"] - len(english.split())) <= 2 and got[1][0]["word_start"] == 0 and got[1][-1]["word_end"] == len(rows[0][1].split())
