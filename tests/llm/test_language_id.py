import numpy as np

from tests.llm.conftest import DOCUMENT, ODD_ROWS
from tillflow.llm import language_id


def test_held_out_accuracy(table):
    docs = table("documents", "sf0.01")
    found = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(odd):
    result = language_id.identify(odd)
    found = result.collect()
    assert len(found) == len(ODD_ROWS)
    for r in found:
        if r.doc_id in (3, 4, 5, 8):  # null, empty, blank, and digits only
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in found} <= {"und", "en", "fr", "de", "xx"}


def test_nothing_but_the_text_is_looked_at(spark, table):
    docs = table("documents")
    model = language_id.train(docs)
    from pyspark.sql import functions as F

    stripped = docs.select("doc_id", "text")
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    first = {r.doc_id: r.lang_pred for r in language_id.predict(stripped, model).collect()}
    assert first == {r.doc_id: r.lang_pred for r in language_id.predict(changed, model).collect()}


def test_unseen_words_fall_back_to_characters(spark):
    rows = [(i, "der hund und die katze schlafen zusammen", "de", "a", 1) for i in range(5)]
    rows += [(i, "the dog and the cat sleep together", "en", "a", 1) for i in range(5, 10)]
    model = language_id.train(spark.createDataFrame(rows, DOCUMENT))
    assert "hunde" not in model.words
    predict = model.predictor()
    assert predict("hunde schlaf")[0] == "de" and predict("dogs slee")[0] == "en"
    assert predict("qqq")[0] in ("de", "en") and predict(None) == ("und", 0.0) and predict("12 ?")[0] == "und"
    # Backing off stops at the longest length with a known n-gram.
    assert (model.unseen("hunde") == model.table[[model.grams[5][g] for g in language_id.grams_of("hunde", 5) if g in model.grams[5]]].mean(axis=0)).all()


def test_without_training_rows(odd, none):
    from pyspark.sql import functions as F

    assert language_id.identify(none).count() == 0
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unknown).collect()} == {"und"}


def test_cache_of_unseen_words_changes_nothing(table, monkeypatch):
    import pytest

    docs = table("documents")
    model = language_id.train(docs.limit(100), word_share=1e-3)
    texts = [r.text for r in docs.limit(60).collect()]
    expected = [model.predictor()(t) for t in texts]
    monkeypatch.setattr(language_id, "_CACHED_WORDS", 16)
    small = model.predictor()
    for text, (lang, score) in zip(texts, expected, strict=True):
        assert small(text) == (lang, pytest.approx(score, abs=1e-6))


def test_a_language_with_a_ten_thousandth_of_the_rows_has_its_own_entries(spark):
    """Its words and n-grams stay by their share of its own text, and its counts stay beside those of a large language."""
    import numpy as np
    from pyspark.sql import functions as F

    large = spark.range(9999).select(F.col("id").alias("doc_id"), F.lit("the dog and the cat sleep on the bar " * 20).alias("text"), F.lit("en").alias("lang"))
    small = spark.createDataFrame([(9999, "hvalen og bar katten sover på isen ved fjorden")], "doc_id long, text string").withColumn("lang", F.lit("da"))
    model = language_id.train(large.unionByName(small))
    assert {"hvalen", "fjorden"} <= set(model.words) and "<fjor" in model.grams[5]
    n_large, n_small, entries = 9999 * 9 * 20, 9, len(model.words)
    da, en = model.table[model.words["bar"]]
    assert np.isclose(da, np.log(1.5 / (n_small + 0.5 * (entries + 1)))) and np.isclose(en, np.log((9999 * 20 + 0.5) / (n_large + 0.5 * (entries + 1))))
    predict = model.predictor()
    assert predict("katten sover ved fjorden")[0] == "da" and predict("the cat and the dog")[0] == "en" and predict("fjord is")[0] == "da"


def plain_predictions(rows):
    """Language and score of each text by counting in dictionaries: words first, then n-grams from the longest down."""
    import math
    import re
    from collections import Counter
    from zlib import crc32

    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "").lower())
        return re.findall(r"[a-z\x80-\U0010ffff]+", lowered)

    def grams(word, n):
        marked = f"<{word}>" if n > 1 else word
        return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]

    counts = {}  # (size, language) -> entries
    for i, text, lang in rows:
        if lang is None or text is None or crc32(("" if i is None else str(i)).encode()) % 3 == 1:
            continue
        for word in words(text):
            counts.setdefault((0, lang), Counter())[word] += 1
            for n in range(1, 6):
                for g in grams(word, n):
                    counts.setdefault((n, lang), Counter())[g] += 1
    names = sorted({lang for _, lang in counts})
    entries = {n: set().union(*[counts[n, x] for x in names]) for n in range(6)} if names else {}

    def log(n, lang, entry):
        table = counts[n, lang]
        return math.log((table[entry] + 0.5) / (sum(table.values()) + 0.5 * (len(entries[n]) + 1)))

    def of_word(word):
        if word in entries[0]:
            return [log(0, x, word) for x in names]
        for n in range(5, 0, -1):
            known = [g for g in grams(word, n) if g in entries[n]]
            if known:
                return [sum(log(n, x, g) for g in known) / len(known) for x in names]
        return [0.0] * len(names)

    out, seen = [], {}
    for i, text, _ in rows:
        if not names or not any(c.isalpha() for c in text or ""):
            out.append((i, "und", 0.0))
            continue
        total = [0.0] * len(names)
        for word in words(text):
            if word not in seen:
                seen[word] = of_word(word)
            total = [a + b for a, b in zip(total, seen[word], strict=True)]
        likely = [math.exp(t - max(total)) for t in total]
        best = likely.index(max(likely))
        out.append((i, names[best], likely[best] / sum(likely)))
    return out


def test_predictions_equal_plain_counting(spark):
    """Every document of a small table, held out and not, and odd rows; languages of very different size."""
    import random

    import pytest

    rng = random.Random(12)
    syllables = {"aa": "ka to mi lu ne sa".split(), "bb": "xr zo pli ku tan ei".split(), "cc": "ka zo é lu ßa tan".split()}
    rows = []
    for i in range(150):
        lang = rng.choice(["aa"] * 8 + ["bb"] * 2 + ["cc"])
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 40)))
        rows.append((i, text.title() if i % 3 else text, None if i % 11 == 0 else lang, "a", 1))
    rows += [r for r in ODD_ROWS if r[0] not in (6, 9)]
    found = language_id.identify(spark.createDataFrame(rows, DOCUMENT)).collect()
    expected = plain_predictions([(r[0], r[1], r[2]) for r in rows])
    by = lambda r: (str(r[0]), str(r[1]), round(r[2], 3))
    for a, b in zip(sorted(((r.doc_id, r.lang_pred, r.score) for r in found), key=by), sorted(expected, key=by), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)
    assert len({r.lang_pred for r in found}) >= 4


def test_unseen_words_together_equal_one_by_one(table, monkeypatch):
    """New words of a text are looked up in bulk; words without any known n-gram have zeros."""
    model = language_id.train(table("documents").limit(100), word_share=1e-3)
    words = ["hunde", "strasse", "x", "世界", "zzzzqqqq", "the", "café"] * 3
    monkeypatch.setattr(language_id, "_UNSEEN_AT_ONCE", 4)
    np.testing.assert_allclose(model.unseen_rows(words), [model.unseen(w) for w in words], rtol=1e-6)
    monkeypatch.setattr(model, "unseen", None)  # a text's new words do not go one by one
    assert model.predictor()("hunde strasse zzzzqqqq")[0] in model.names
