"""Vectors, labels, urls, conversations, the language model and the pipeline, on small fixtures."""

import math
import random
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from demandloom.llm.chat import format_conversations  # noqa: E402
from demandloom.llm.components import connected_components  # noqa: E402
from demandloom.llm import language_model as lm  # noqa: E402
from demandloom.llm.toxicity import classify_toxicity  # noqa: E402
from demandloom.llm.url_filter import filter_urls  # noqa: E402
from demandloom.llm.vectors import similar_vectors  # noqa: E402


def test_connected_components_of_a_long_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((6, 16))
    x = np.repeat(centers, 40, 0) + rng.standard_normal((240, 16)) * 0.11
    rows = [(i, int(i % 3), [float(v) for v in x[i]]) for i in range(240)]
    rows += [(300 + i, 1, rows[5][2]) for i in range(5)] + [(310, None, rows[5][2]), (311, 1, None), (312, 1, [0.0] * 16), (313, 1, [float("nan")] * 16)]
    rows += [(314, 1, [None] * 16), (315, 1, []), (316, 1, [1.0, 2.0]), (317, 1, [2.0, 4.0]), (300, 1, rows[5][2]), (None, 1, rows[5][2])]
    made = spark.createDataFrame([(*r, 0, "x") for r in rows], "SKU long, Category long, features array<float>, cell int, copies string")
    got = sorted(similar_vectors(made, cell_rows=12).collect(), key=lambda r: (r.SKU is None, r.SKU or 0, r.n_links))
    clean = [(k, c, np.array(v, np.float32).astype(float)) for k, c, v in rows if k is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, links = {}, []
    for i, (a, c, u) in enumerate(clean):
        for j, (b, d, w) in enumerate(clean):
            if i != j and c == d and len(u) == len(w) and u @ w >= 0.98 * math.sqrt((u @ u) * (w @ w)):
                n[a] = n.get(a, 0) + 1 / sum(k == a for k, *_ in clean)
                links.append((a, b))
    groups = brute.components({k for k, *_ in rows if k is not None}, links)
    assert len(got) == len(rows) and sum(n.values()) > 100
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == ((round(n.get(r.SKU, 0)), groups[r.SKU], groups[r.SKU] == r.SKU) if r.SKU is not None else (0, None, True))
    assert similar_vectors(made.limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    def text(bad, poor):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        return " ".join(w + rng.sample(["vile", "nasty", "Rotten,", "foul"], 2) * bad + ["spam", "click"] * poor)
    marks = [(i, int(rng.random() < 0.3), int(rng.random() < 0.4)) for i in range(500)]
    docs = [(i, text(t, 1 - q), 9.0) for i, t, q in marks] + [(900, None, 1.0), (901, "", 1.0), (None, "vile foul", 1.0), (902, "vile " * 3000, 1.0), (902, "vile " * 3000, 1.0)]
    items = spark.createDataFrame(docs, "SKU long, Product_Name string, toxic_probability double")
    labels = spark.createDataFrame([(i, q, t) for i, t, q in marks[:350]] + [(None, 1, 1), (1, None, 0), (7777, 1, 1)], "SKU long, quality int, toxic int")
    got = classify_toxicity(items, labels).collect()
    assert len(got) == len(docs)
    by = {r.SKU: r for r in got}
    right = sum(by[i].toxic_predicted == bool(t) for i, t, _ in marks[350:])
    assert right >= 0.95 * 150 and sum((by[i].quality_probability >= 0.5) == bool(q) for i, _, q in marks[350:]) >= 0.95 * 150
    assert by[902].toxic_predicted and all(0 <= r.toxic_probability <= 1 for r in got)
    assert all(r.toxic_probability == 0 for r in classify_toxicity(items, labels.limit(0)).collect())
    assert classify_toxicity(items.limit(0), labels).collect() == []


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def test_url_rules_and_link_graph(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://A.Example.NET/en/1?q#f", None), (2, "http://example.net/de/1", ""), (3, "https://notexample.com/de/", ""), (4, "ftp://x.example.com/de/9", ""),
        (5, "http://a.org/fr/", link("good.io")), (6, None, None), (7, "no scheme", ""), (8, "http://bad.net", ""), (9, "http://evil.net/x", ""),
        (10, "http://farm.io/1", link("evil.net", "EVIL.net:80".split(":")[0])), (11, "http://good.io/2", link("a.org")), (12, "http://mid.io/", link("farm.io", "good.io")), (None, "http://x.net/#", ""),
        (13, "http://h.com?x=/de/", ""), (9, "http://evil.net/x", ""),
    ]
    got = filter_urls(spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, rule string"), RULES).collect()
    assert len(got) == len(pages)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by[2] == ("example.net", "/de/1", "net/", "block")
    assert by[3] == ("notexample.com", "/de/", None, "allow") and by[4] == ("x.example.com", "/de/9", "example.com/de/", "block")
    assert by[5][2:] == ("org/fr/", "allow") and by[6] == ("", "", None, "allow") and by[7] == ("", "", None, "allow")
    assert by[8] == ("bad.net", "", None, "allow") and by[None] == ("x.net", "/", "net/", "block") and by[13] == ("h.com", "", None, "allow")
    assert by[10][3] == "block" and by[11][3] == "allow"
    score = {r.host: (r.trust, r.distrust) for r in got}
    # Dense power iteration over the same host graph.
    hosts, out = sorted(score), {"a.org": ["good.io"], "farm.io": ["evil.net"], "good.io": ["a.org"], "mid.io": ["farm.io", "good.io"]}
    seed_t, seed_b = {"a.org": 1.0, "a.example.net": 1.0}, {"x.example.com": 1.0, "evil.net": 1.0, "example.net": 1.0, "x.net": 1.0}
    into = {h: [g for g in out if h in out[g]] for h in hosts}
    trust, distrust = dict(seed_t), dict(seed_b)
    for _ in range(10):
        trust = {h: seed_t.get(h, 0) + 0.85 * sum(trust.get(g, 0) / len(out[g]) for g in into[h]) for h in hosts}
        distrust = {h: seed_b.get(h, 0) + 0.85 * sum(distrust.get(g, 0) / len(into[g]) for g in out.get(h, [])) for h in hosts}
    for h in hosts:
        assert score[h] == (pytest.approx(trust[h]), pytest.approx(distrust[h]))
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []


def test_url_distrust_reaches_hosts_past_ten_links(spark):
    pages = [(0, "http://evil.net/x", "")] + [(i, f"http://h{i}.io/", f'<a href="http://{f"h{i - 1}.io" if i > 1 else "evil.net"}/">') for i in range(1, 13)]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, rounds=None).collect()
    for r in got:
        assert r.distrust == pytest.approx(0.85**r.page_id)


def test_conversations_collapse_to_the_longest(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    talks = {1: a, 2: a[:2], 3: a[:1], 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", None)], 7: [(None, "")], 8: [("assistant", "hi")]}
    rows = [(k, i, r, t, "z") for k, x in talks.items() for i, (r, t) in enumerate(x)]
    rows += [(1, 0, "user", "hi", "z"), (None, 0, "user", "lost", "z"), (9, 5, "user", "b", "z"), (9, 5, "user", "a", "z")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in format_conversations(made).collect()}
    assert set(got) == {1, 5, 6, 7, 8, 9, None}
    assert got[1] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert got[7][2] == "<|im_start|>unknown\n<|im_end|>\n" and got[6][2] == "<|im_start|>user\n<|im_end|>\n" and got[9][2].index("\na") < got[9][2].index("\nb")
    assert format_conversations(made.limit(0)).collect() == []


def test_language_model_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.first_parameters(rng.integers(1, 50, lm.HEAD).astype(float), 100.0).items()}
    state = rng.standard_normal((1, lm.STATE))
    every = np.arange(lm.HEAD + 1)
    assert np.exp(lm.output(p, np.repeat(state, len(every), 0), every)[0]).sum() == pytest.approx(1)
    grads = {}
    target = np.array([3, 700, lm.HEAD])
    states = rng.standard_normal((3, lm.STATE))
    _, back = lm.output(p, states, target, grads)
    loss = lambda: -lm.output(p, states, target)[0].sum()
    inner = {"ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
    for c, (w, b) in grads["members"].items():
        inner["ww"][c], inner["bw"][c] = w, b
    grads |= inner
    for name, at in (("wc", (5, 2)), ("bc", (32,)), ("ww", (0, 3, 4)), ("bw", (2, 28)), ("bw", (21, 28))):
        old, e = p[name][at], 1e-5
        p[name][at] = old + e
        up = loss()
        p[name][at] = old - e
        down = loss()
        p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-7)
    states[1, 3] += 1e-5
    up = loss()
    states[1, 3] -= 2e-5
    assert back[1, 3] == pytest.approx((up - loss()) / 2e-5, rel=1e-4)


def test_text_score_does_not_depend_on_lanes_or_windows():
    rng = np.random.default_rng(1)
    p = lm.first_parameters(np.ones(lm.HEAD), 5.0)
    lengths = np.array([1, 150, 3, 70, 500])
    tokens = rng.integers(0, lm.HEAD + 1, lengths.sum()).astype(np.int32)
    got = lm.text_scores(p, tokens, lengths, 4)
    at = 0
    for i, n in enumerate(lengths):
        h, last, total = np.zeros((1, lm.STATE), np.float32), 4, 0.0
        for w in tokens[at : at + n]:
            h = lm.step(p, h, np.array([last]))[0]
            total += lm.output(p, h, np.array([w]))[0][0]
            last = w
        at += n
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_scores_of_items(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice(x) for _ in range(40)) for x in (["red", "green", "blue"], ["un", "deux", "trois"]) for _ in range(60)]
    rows = [(i, t, 0.0) for i, t in enumerate(lines)] + [(500, None, 0.0), (501, "", 0.0), (502, "never Seen words", 0.0), (None, "red", 0.0), (503, "red " * 9000, 0.0), (503, "red " * 9000, 0.0)]
    items = spark.createDataFrame(rows, "SKU long, Product_Name string, n_known double").repartition(2)
    got = lm.score_texts(items, F.col("SKU") % 5 != 1).collect()
    counts = {}
    for k, t, _ in rows:
        if k is None or k % 5 != 1:
            for w in [*brute.words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, total = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    texts = {k: t for k, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        w = [*brute.words(texts[r.SKU]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.SKU is not None and r.SKU % 5 == 1, len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 0.5) / total) for x in w))
    held = [r for r in got if r.held_out and r.SKU < 500]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    empty = lm.score_texts(items, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in empty)
    assert lm.score_texts(items.limit(0), F.lit(True)).collect() == []


def test_language_model_learns_every_training_text(spark):
    """A text with many copies is learned whatever its hash is; earlier a hash sample of a quarter of these texts was."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    tries = spark.createDataFrame([(" ".join(rng.sample(words, 12)),) for _ in range(40)], "t string")
    outside = tries.where(F.pmod(F.xxhash64(F.lit("teach"), "t"), F.lit(1 << 20)) > 0.3 * (1 << 20)).first()[0]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(4000)] + [outside] * 4000
    rng.shuffle(texts)
    items = spark.createDataFrame(list(enumerate(texts)), "SKU long, Product_Name string").repartition(2)
    got = lm.score_texts(items, F.lit(True)).where(F.col("n_tokens") == 13).toPandas()
    copies = got[[texts[k] == outside for k in got.SKU]]
    assert len(copies) == 4000 and (copies.score > copies.base_score + 3).all()


def test_language_model_prepares_a_large_vocabulary_in_linear_time(spark):
    """Counts of 65,536 head words are looked up once, not once per word."""
    words = [f"w{i}" for i in range(70_000)]
    items = spark.createDataFrame([(i, " ".join(words[i::4])) for i in range(4)] + [(9, "w1 w2 w3")], "SKU long, Product_Name string")
    began = time.monotonic()
    got = lm.score_texts(items, F.col("SKU") < 9).where("SKU = 9").first()
    assert time.monotonic() - began < 90
    assert (got.n_tokens, got.n_known, got.train_tokens) == (4, 4, 70_004)


def test_language_model_tells_apart_words_past_the_commonest_thousand():
    rng = np.random.default_rng(3)
    p = lm.first_parameters(np.full(3000, 5.0), 1.0)
    pairs = np.array([[1500, 2000, 0], [1501, 2700, 0]], np.int32)
    tokens, lengths = pairs[rng.integers(0, 2, 6000)].ravel(), np.full(6000, 3)
    for _ in range(6):
        p = lm.train(p, tokens, lengths, 0, 0.03)
    right = lm.text_scores(p, pairs.ravel(), np.array([3, 3]), 0)
    wrong = lm.text_scores(p, pairs[:, [0, 1, 2]][[0, 1]].ravel()[[0, 4, 2, 3, 1, 5]], np.array([3, 3]), 0)
    assert (right > wrong + 1).all()


def test_language_model_weighs_few_outputs_for_each_token(monkeypatch):
    """Four choices of 16 and the tail, not all classes and then all members of a class; earlier 513 numbers for each token."""
    rng, seen, plain = np.random.default_rng(5), [], lm.picked

    def counted(a, *rest):
        seen.append(a.size)
        return plain(a, *rest)

    monkeypatch.setattr(lm, "picked", counted)
    p = lm.first_parameters(np.ones(lm.HEAD), 5.0)
    target = rng.integers(0, lm.HEAD + 1, 2000)
    grads = {}
    got, _ = lm.output(p, rng.standard_normal((2000, lm.STATE)).astype(np.float32), target, grads)
    assert sum(seen) <= 80 * len(target) and np.isfinite(got).all()
    for x in p.values():
        x *= 300  # sums of exponentials leave the range of floats
    got, _ = lm.output(p, rng.standard_normal((2000, lm.STATE)).astype(np.float32), target, {})
    assert np.isfinite(got).all() and (got <= 1e-3).all()


def test_language_model_blocks_are_averaged_by_the_tokens_of_their_words():
    import pyarrow as pa

    p, q = (lm.first_parameters(np.full(10, 5.0), 1.0) for _ in range(2))
    shape = p["bw"].shape
    for x in q.values():
        x += 1
    times = np.arange(shape[0] * shape[1] + 1, dtype=float)
    rows = [(c, *lm.get_block(x, c, t)) for x, t in ((p, times), (q, 3 * times)) for c in range(shape[0] + 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), *(pa.array([r[i].tobytes() for r in rows]) for i in (1, 2))], names=["block", "n", "v"])
    got = {k: np.full_like(v, 9) for k, v in p.items()}
    for out in lm.averaged([batch], shape):
        r = out.to_pylist()[0]
        lm.put_block(got, r["block"], np.frombuffer(r["n"]), np.frombuffer(r["v"], np.float32))
    assert (got["x"][0] == 9).all()  # a word without tokens keeps its row
    got["x"][0] = p["x"][0] + 0.75
    for k in p:
        assert got[k] == pytest.approx(p[k] + 0.75, rel=1e-5)


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == before.columns
        texts, kept = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()}
        if i == 0:
            assert set(texts) - set(kept) == {k for k, t in texts.items() if not any(c.isalpha() for c in t or "")}
        if i == 1:
            groups = brute.similar(texts)[1]
            assert set(kept) == set(groups.values())
        if i == 2:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(kept) == {k for k, x in brute.passages(texts, bench).items() if not x[1]}
        if i == 3:
            assert set(kept) == set(texts) and all(t == texts[k] or "[SECRET]" in t for k, t in kept.items())
    assert {r.doc_id for r in docs.collect()} == set(kept)
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_columns_named_like_its_own(spark):
    from demandloom.llm.stages import keep_known_languages

    docs = spark.createDataFrame([(i, "the cat and the dog", "en", "x", 0.5) for i in range(12)] + [(50, "12", "en", "y", 0.7)], "doc_id long, text string, lang string, lang_pred string, score double")
    got = keep_known_languages(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in got.collect()) == [(i, "x", 0.5) for i in range(12)]
