"""The language models and bands of op4_perplexity."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import perplexity


PAD, STOP = -1, -2


def ngrams(text):
    """The n-grams of the highest order that end at each symbol of a text and its stop."""
    x = [PAD] * perplexity.DEPTH + [ord(c) for c in text] + [STOP]
    return [tuple(x[i - perplexity.DEPTH + 1 : i + 1]) for i in range(perplexity.DEPTH, len(x))]


def kneser_ney_counts(texts):
    """By order from 1: occurrences for the highest, distinct preceding symbols below."""
    counts = {perplexity.DEPTH: Counter(g for t in texts for g in ngrams(t))}
    for k in range(perplexity.DEPTH - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def plain_nats(texts, langs):
    """Modified Kneser-Ney in dictionaries: mean negative log probability of each text's symbols by all other texts of its language."""
    every = [kneser_ney_counts([t for t, x in zip(texts, langs) if x == lang]) for lang in set(langs)]
    discount = {}
    for k in range(1, perplexity.DEPTH + 1):
        t = [sum(n == i for c in every for n in c[k].values()) for i in range(1, 5)]
        y = t[0] / max(1, t[0] + 2 * t[1])
        discount[k] = [0, 0.5, 0.75, 0.9] if min(t[:3]) == 0 else [0, *(min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))]
    out = []
    for own, (text, lang) in enumerate(zip(texts, langs)):
        counts = kneser_ney_counts([t for i, (t, x) in enumerate(zip(texts, langs)) if x == lang and i != own])
        followers = {k: defaultdict(list) for k in counts}
        for k, of in counts.items():
            for g, n in of.items():
                followers[k][g[:-1]].append(n)

        def probability(gram):
            k = len(gram)
            if not k:
                return 1 / (0x110001 + 1)
            below = probability(gram[1:])
            ns = followers[k].get(gram[:-1])
            if not ns:
                return below
            d = discount[k]
            n = counts[k][gram]
            return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in ns) * below) / sum(ns)

        out.append(-sum(np.log(probability(g)) for g in ngrams(text)) / (len(text) + 1))
    return out


def scored(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(parts, "doc_id")
    return {r.doc_id: r for r in perplexity.score_quality(docs).collect()}


@pytest.fixture(scope="module")
def clean(spark, data):
    """Labelled-good prose, by language."""
    d = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    rows = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").where("length(text) between 600 and 20000").orderBy("doc_id").collect()
    out = defaultdict(list)
    for r in rows:
        if len(out[r.lang]) < 300:
            out[r.lang].append(r.text)
    return out


def test_every_document_is_counted_and_scored_by_the_others(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab| é\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["||||####", "", "same", "same"]
    langs = [rng.choice(["x", "y", None]) for _ in texts]
    got = scored(spark, list(zip(texts, langs)))
    want = plain_nats(texts, langs)
    assert all(np.isclose(np.log(got[i].perplexity), w, rtol=1e-6) for i, w in enumerate(want)), [(i, np.log(got[i].perplexity), w) for i, w in enumerate(want)][:9]


def test_texts_full_of_symbols_are_learned(spark, clean):
    tables = [t.replace(" ", " | ") for t in clean["en"]]  # far over 5 % symbols
    got = scored(spark, [(t, "en") for t in tables])
    assert np.mean([got[i].kept for i in range(len(tables)) if not got[i].base_failed]) > 0.95
    mixed = scored(spark, [(t, "en") for t in clean["en"] + tables[:3]])
    n = len(clean["en"])
    assert not any(mixed[n + i].kept for i in range(3))  # few tables in prose are foreign by the model itself


def test_bands_come_from_the_languages_own_spread(spark, clean):
    rng = random.Random(4)
    rows = [(t, lang, "clean") for lang in ("en", "de", "fr") for t in clean[lang]]

    def shuffled(t):
        words = t.split()
        rng.shuffle(words)
        return " ".join(words)

    def junk(t):  # every eighth word
        return " ".join(w + rng.choice(["##", "$$", "&&"]) if i % 8 == 0 else w for i, w in enumerate(t.split(" ")))

    for lang, other in (("en", "de"), ("de", "fr"), ("fr", "en")):
        rows += [(t, other, "wrong") for t in clean[lang][:3]]
        rows += [(shuffled(t), lang, t) for t in clean[lang][3:13]]
        rows += [(junk(t), lang, t) for t in clean[lang][13:23]]
    got = scored(spark, [r[:2] for r in rows])
    kept = lambda kind: np.mean([got[i].kept for i, r in enumerate(rows) if r[2] == kind and not got[i].base_failed])
    assert kept("clean") > 0.95 and kept("wrong") == 0
    # Words in random order, and a pair of marks at every eighth word: worse than the text itself, if often within the band.
    of = {t: got[i].perplexity for i, (t, _, kind) in enumerate(rows) if kind == "clean"}
    worse = [got[i].perplexity > of[kind] for i, (_, _, kind) in enumerate(rows) if kind in of]
    assert len(worse) == 60 and np.mean(worse) > 0.9


def test_the_model_grows_with_the_alphabet_and_the_text(spark):
    rng = random.Random(5)

    def entries(n, alphabet):
        texts = ["".join(rng.choice(alphabet) for _ in range(400)).encode() for _ in range(n)]
        return sum(len(k) for k, _ in perplexity.gram_counts(perplexity.Grams(texts, ["x"] * n)))

    alphabet = [chr(c) for c in (*range(65, 91), *range(48, 58), *range(0x430, 0x450), *range(0x4E00, 0x4F00))]
    assert entries(400, alphabet) > 8 * entries(40, alphabet)  # ten times the text
    a, b = (np.concatenate([k for k, _ in perplexity.gram_counts(perplexity.Grams([t.encode()], ["x"]))]) for t in ("ШЩ ABC 12", "ЩШ BAC 21"))
    assert len(set(a) & set(b)) < len(a) / 2  # no two letters or digits are one symbol
