"""Language identification against a plain recomputation, and languages with few labelled rows."""

import collections
import math
import random
import re
import tracemalloc

import pytest

from demandloom.llm.language import LONGEST_GRAM, fit_language_model, identify_language

SPLIT = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [w for w in SPLIT.split(text.lower()) if w]


def grams(word, n):
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def expected(training, text):
    names = sorted({lang for _, lang in training})
    tables = [collections.defaultdict(lambda: [0] * len(names)) for _ in range(LONGEST_GRAM + 1)]
    for t, lang in training:
        for w in words(t):
            tables[0][w][names.index(lang)] += 1
            for n in range(1, LONGEST_GRAM + 1):
                for g in grams(w, n):
                    tables[n][g][names.index(lang)] += 1
    sums = [[sum(r[k] for r in t.values()) for k in range(len(names))] for t in tables]
    log = lambda n, x, k: math.log((tables[n][x][k] + 0.1) / (sums[n][k] + 0.1 * (len(tables[n]) + 1)))
    total = [0.0] * len(names)
    for w in words(text):
        if w in tables[0]:
            part = [log(0, w, k) for k in range(len(names))]
        else:
            part = [0.0] * len(names)
            for n in range(LONGEST_GRAM, 0, -1):
                known = [g for g in grams(w, n) if g in tables[n]]
                if known:
                    part = [sum(log(n, g, k) for g in known) / len(known) for k in range(len(names))]
                    break
        total = [a + b for a, b in zip(total, part)]
    best = max(range(len(names)), key=lambda k: (total[k], -k))
    return names[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_equals_a_plain_recomputation(spark):
    rng = random.Random(6)
    make = lambda syllables, n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    parts = {"aa": ["ka", "lo", "mi", "ü"], "bb": ["ka", "ste", "rön"], "cc": ["zu", "lo", "ña"]}
    training = [(make(parts[lang], 12), lang) for lang in parts for _ in range(15)]
    texts = [make(rng.choice(list(parts.values())), rng.randrange(1, 9)) for _ in range(60)] + ["QQQ xxx", "ka"]
    made = spark.createDataFrame([(t, lang, 1) for t, lang in training], "Product_Name string, language string, score int")
    got = identify_language(spark.createDataFrame(list(enumerate(texts)), "SKU long, Product_Name string"), made).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = expected(training, texts[r.SKU])
        assert r.lang_pred == lang and r.score == pytest.approx(score)


@pytest.mark.parametrize("common", [996, 997, 20_000])
def test_a_rare_language_is_learned_at_any_size(spark, common):
    """Words seen once count, below and above a thousand labelled rows, and however many rows other languages have."""
    rows = [(f"the cat number w{i} sat", "en") for i in range(common)] + [(t, "rare") for t in ("zvuk", "hrad", "most", "sklo")]
    made = spark.createDataFrame(rows, "Product_Name string, language string")
    items = spark.createDataFrame([(1, "hrad most zvuk"), (2, "the cat sat")], "SKU long, Product_Name string")
    assert {r.SKU: r.lang_pred for r in identify_language(items, made).collect()} == {1: "rare", 2: "en"}


def test_the_driver_holds_a_few_bytes_for_each_piece(spark):
    """Counts come to the driver as Arrow columns, not as an object for each word and n-gram."""
    rng = random.Random(8)
    rows = [(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=9)) for _ in range(400)), lang) for lang in ("aa", "bb") for _ in range(20)]
    made = spark.createDataFrame(rows, "t string, l string")
    tracemalloc.start()
    try:
        model = fit_language_model(made, "t", "l")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    seen = [w for t, _ in rows for w in words(t)]
    assert len(model.words) == len(set(seen))
    assert [set(x) for x in model.places] == [{g for w in seen for g in grams(w, n)} for n in range(1, LONGEST_GRAM + 1)]
    assert peak < 200 * (len(model.words) + sum(map(len, model.grams)))
