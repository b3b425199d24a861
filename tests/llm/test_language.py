"""The forward sum against all segmentations, and accuracy on held-out texts."""

import math
import random

import numpy as np
import pytest

from tallybook.llm import language

public_tokenizers = pytest.importorskip("public_tokenizers")


def all_segmentations(word, chance):
    if not word:
        return 1.0
    return sum(chance[word[:i]] * all_segmentations(word[i:], chance) for i in range(1, len(word) + 1) if word[:i] in chance)


PIECES = sorted([bytes([b]) for b in b" abc"] + [b" a", b"ab", b"bc", b"abc", b"ca", b" ab"])
WORDS = [b" abc", b" a", b" cabcab", b" b", b" abcabcabca"]


def test_sum_over_segmentations():
    rng = np.random.default_rng(1)
    model = rng.random((2, len(PIECES)))
    model /= model.sum(1, keepdims=True)
    got = language.Segmenter(PIECES).log_likelihoods(WORDS, model)
    want = [[math.log(all_segmentations(w, dict(zip(PIECES, m, strict=True)))) for m in model] for w in WORDS]
    assert np.allclose(got, want)


def test_expected_counts():
    rng = np.random.default_rng(2)
    model = rng.random(len(PIECES))
    model /= model.sum()
    chance = dict(zip(PIECES, model, strict=True))

    def counts(word):
        total, out = all_segmentations(word, chance), dict.fromkeys(PIECES, 0.0)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                if word[i:j] in chance:
                    out[word[i:j]] += all_segmentations(word[:i], chance) * chance[word[i:j]] * all_segmentations(word[j:], chance) / total
        return out

    weights = np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    want = sum(w * np.array(list(counts(word).values())) for word, w in zip(WORDS, weights, strict=True))
    assert np.allclose(language.Segmenter(PIECES).expected(WORDS, weights, model), want)


def test_long_words_beside_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    model = rng.random((2, len(PIECES)))
    model /= model.sum(1, keepdims=True)
    words = [*WORDS, b" " + b"abca" * 50_000, *(b" " + b"abc" * n for n in range(40)), b" a"]
    segmenter, weights = language.Segmenter(PIECES), rng.random(len(WORDS) + 42)
    got, counts = segmenter.log_likelihoods(words, model), segmenter.expected(words, weights, model[0])
    assert np.allclose(got[: len(WORDS)], segmenter.log_likelihoods(WORDS, model)) and np.isfinite(got).all()
    assert (got[len(WORDS)] < -50_000).all()
    # All pieces together cover each byte of each word once.
    bytes_covered = sum(len(p) * c for p, c in zip(PIECES, counts, strict=True))
    assert np.isclose(bytes_covered, sum(len(w) * x for w, x in zip(words, weights, strict=True)))
    # Slices and tables of other sizes give the same.
    monkeypatch.setattr(language, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(language, "PLACES_AT_ONCE", 1_000)
    assert np.allclose(segmenter.log_likelihoods(words, model), got)
    assert np.allclose(segmenter.expected(words, weights, model[0]), counts)


def test_languages_without_blanks_are_learned(spark):
    """Texts of one long run each teach their language; copies of a text count once."""
    rng = random.Random(5)
    letters = {"en": "etaoinshr", "ja": "のにはをたがで日本語文"}
    text = lambda lang: "".join(rng.choices(letters[lang], k=rng.randint(100, 400)))
    labelled = [(text(lang), lang) for lang in ("en", "ja") for _ in range(20)]
    labelled += [labelled[0]] * 300
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    languages, model = language.fit(spark.createDataFrame(labelled, "text string, lang string"), path, rounds=2)
    once = language.fit(spark.createDataFrame(sorted(set(labelled)), "text string, lang string"), path, rounds=2)
    assert languages == ["en", "ja"] and np.allclose(model, once[1])
    asked = [(i, text(("en", "ja")[i % 2])) for i in range(20)] + [(21, "日本語" * 20_000)]
    got = language.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), path, languages, model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {i: ("en", "ja")[i % 2] for i, _ in asked}


def test_held_out_texts(spark):
    rng = random.Random(3)
    syllables = {"de": ["ung", "sch", "keit", "ei", "ü"], "en": ["the", "ing", "wh", "ou", "ed"], "fr": ["eau", "é", "oi", "tre", "ç"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))
    labelled = [(i, text(lang := rng.choice(list(syllables)), 30), lang) for i in range(150)] + [(900, None, "de"), (901, "x", None)]
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    languages, model = language.fit(spark.createDataFrame(labelled, "doc_id bigint, text string, lang string"), path, per_language=60, rounds=2)
    assert languages == ["de", "en", "fr"] and np.allclose(model.sum(1), 1)
    asked = [(1000 + i, text(lang := rng.choice(list(syllables)), 12), lang) for i in range(80)]
    asked += [(1, None, "und"), (2, "", "und"), (3, "12 !? \n", "und"), (4, "THE WHOU, ING" * 30_000, "en"), (4, "THE WHOU, ING" * 30_000, "en"), (None, "ungscheit", "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in asked], "doc_id bigint, text string, lang string, score double")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.predict(df, path, languages, model).collect())
    assert sum(a == b for a, b in zip(got, sorted((str(i), lang) for i, _, lang in asked), strict=True)) >= len(asked) - 1
    scores = language.predict(df, path, languages, model)
    assert scores.where("score < 0 or score > 1 or (lang_pred = 'und') != (score = 0)").count() == 0
    nothing = language.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"), path)
    assert {r.lang_pred for r in language.predict(df.limit(5), path, *nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), path, languages, model).count() == 0
