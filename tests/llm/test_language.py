"""Language ID by brute force: n-grams one by one, a classifier solved for each bit, each row left out in turn, losses in loops."""

import math
import random
import zlib

import numpy as np
import pytest

from spanveil.llm import langid

WORDS = {"en": "the and of house water bridge morning slowly", "de": "der und das häuser wasser brücke morgen langsam", "fr": "le et la maison l'eau pont matin lentement", "es": "el y la casa agua puente mañana despacio"}


def classes_of(text):
    """The class of each 1-, 2- and 3-gram of letters; a gap stands at both ends and for whatever is no letter."""
    low = text.lower()
    codes = [0, *(ord(c) if ord(c) >= 0x10000 or c.isalpha() else 0 for c in low), 0]
    m = 2**32
    one = [c * 0x9E3779B1 % m for c in codes]
    two = [(one[i] ^ codes[i + 1] * 0x85EBCA77 % m) * 0xC2B2AE3D % m for i in range(len(codes) - 1)]
    three = [(two[i] ^ codes[i + 2] * 0x27D4EB2F % m) * 0x165667B1 % m for i in range(len(codes) - 2)]
    grams = [one[i] for i in range(len(codes)) if codes[i]]
    grams += [two[i] for i in range(len(two)) if codes[i] or codes[i + 1]]
    grams += [three[i] for i in range(len(three)) if codes[i + 1]]
    return [g >> 20 for g in grams]


def features(text):
    out = np.zeros(langid.DIMS)
    for c in classes_of(text):
        out[c] += 1
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


def brute(train, texts, ridge=0.05, sharpness=8.0):
    langs = sorted({x for _, x in train})
    words = [[1 - 2 * ((c >> i) & 1) for i in range(len(langs))] for c in range(1, 2 ** (len(langs) - 1))]  # a bit each
    x = np.array([features(t) for t, _ in train])
    y = np.array([[w[langs.index(lang)] for w in words] for _, lang in train], float)
    solve = lambda a, b: a.T @ np.linalg.solve(a @ a.T + ridge * np.eye(len(a)), b)
    right = np.zeros(y.shape)
    for i in range(len(x)):
        others = np.arange(len(x)) != i
        right[i] = (x[i] @ solve(x[others], y[others])) * y[i] > 0
    trust = np.array([right[[k for k, (_, own) in enumerate(train) if own == lang]].mean(axis=0) + 1e-6 for lang in langs])
    weights, out = solve(x, y), []
    for text in texts:
        margins = features(text) @ weights
        loss = [sum(trust[i][b] / trust[i].sum() * math.exp(-margins[b] * words[b][i]) for b in range(len(words))) for i in range(len(langs))]
        share = [math.exp(-sharpness * (v - min(loss))) for v in loss]
        out.append((langs[loss.index(min(loss))], 1 / sum(share), sorted(loss)[1] - min(loss)))
    return out


def test_counts_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB é.İß1 \U0001f600中\n") for _ in range(rng.randrange(1, 40)))
        want = np.zeros(langid.DIMS, int)
        for c in classes_of(text):
            want[c] += 1
        assert (langid.counts_of(text) == want).all(), repr(text)


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "es"]])
def test_identify_by_brute_force(spark, langs):
    rng, rows = random.Random(len(langs)), []
    for i in range(90):
        lang = rng.choice(langs)
        mixed = WORDS[lang].split() + rng.choice([[], WORDS[rng.choice(langs)].split()])
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(rng.choice((1, 3, 20)))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs.filter(~langid.held_out()))).collect()}
    for (i, _, _), (lang, score, lead) in zip(rows, brute(train, [t for _, t, _ in rows]), strict=True):
        assert abs(got[i].score - score) < 1e-3, i
        assert lead < 1e-3 or got[i].lang_pred == lang, i
        assert abs(lead - 0.02) < 1e-3 or got[i].ambiguous == (lead < 0.02)
