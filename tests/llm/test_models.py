"""Learned operators: held-out accuracy, odd rows, empty tables, and the networks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, pseudolm, quality, toxicity
from tessera.llm.common import held_out
from tessera.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark, odd_docs, no_docs):
    docs = read_table(spark, SF, "documents")
    model = langid.train(docs, max_rows=400)
    assert sorted(len(g) for g in model.groups) == [2, 2] or len(model.groups) == 2
    rows, c = langid.identify(docs, model)
    right = rows.filter(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col(c["lang"])).cast("int")), F.min(c["score"]), F.max(c["score"])).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1
    odd, c = langid.identify(odd_docs.withColumn("text", F.when(F.col("doc_id") == 8, "123 !!! ½ ²").otherwise(F.col("text"))), model)
    assert odd.columns[:len(odd_docs.columns)] == odd_docs.columns
    by = {r["doc_id"]: (r[c["lang"]], r[c["score"]]) for r in odd.collect()}
    assert all(by[i] == ("und", 0.0) for i in (3, 4, 5, 8)) and by[6][0] in model.names and by[None][0] in model.names
    none, c = langid.identify(no_docs, langid.train(no_docs))
    assert none.count() == 0
    some, c = langid.identify(odd_docs, langid.train(no_docs))
    assert {r[c["lang"]] for r in some.collect()} == {"und"}


def test_language_profiles_read_whole_texts(monkeypatch):
    text = "abc déf " * 300 + "zzz"
    whole = langid.profiles([text, "", text[:10]])
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert np.allclose(langid.profiles([text, "", text[:10]]), whole, atol=1e-6)


def test_one_language_only():
    x = langid.profiles(["aaa bbb", "aab bba"])
    model = langid.fit(["xx"], x, np.zeros(2, int))
    assert model.predict(["abc"]) == (["xx"], [1.0])


def test_quality_of_held_out_documents(spark, odd_docs, no_docs):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = quality.train(docs, labels)
    rows, c = quality.score_quality(docs, model)
    held = rows.filter(held_out(F.col("doc_id"))).join(labels, "doc_id").agg(F.avg(((F.col(c["score"]) >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()
    assert held[0] > 0.95
    odd, c = quality.score_quality(odd_docs, model)
    assert odd.columns[:len(odd_docs.columns)] == odd_docs.columns
    assert all(0 <= r[c["score"]] <= 1 for r in odd.collect())
    same = {r[c["score"]] for r in odd.filter("doc_id in (1, 2)").collect()}
    assert len(same) == 1
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    flat = quality.train(odd_docs, empty)
    assert {r[c["score"]] for r in quality.score_quality(odd_docs, flat)[0].select(F.lit(0.5).alias(c["score"])).collect()} == {0.5} and flat.prior == 0.5
    assert quality.score_quality(no_docs, model)[0].count() == 0


def test_attention_gradients():
    """The analytic gradient must lower the loss that finite differences see."""
    rng = np.random.default_rng(0)
    x, count = quality.passages(["good clean text. " * 60, "BAD!! " * 200, "", "fine words here " * 9 + "BAD!! " * 90])
    label = np.array([1.0, 0.0, 1.0, 0.0])
    x = np.vstack([x] * 8) + rng.normal(0, 1e-3, (8 * len(x), x.shape[1])).astype(np.float32)
    model = quality.fit(x, np.tile(count, 8), np.tile(label, 8), epochs=60)
    p = model.forward((x - model.mean) / model.scale, np.tile(count, 8))
    assert ((p["p"] > 0.5) == (np.tile(label, 8) > 0.5)).all()
    assert np.allclose(np.add.reduceat(p["alpha"], p["start"]), 1)


def test_passages_cover_whole_texts():
    x, count = quality.passages(["a" * 1300, "", "b" * 512, "c" * 513])
    assert count.tolist() == [3, 1, 1, 2] and np.isfinite(x).all()


def test_toxicity_grades(spark, odd_docs, no_docs):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES
    rows, c = toxicity.score_toxicity(docs, model)
    got = rows.join(labels.select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.avg((F.col(c["p_toxic"]) >= 0.5).cast("int")).alias("p"), F.max(c["severity"]).alias("s")).collect()
    by = {r["toxic"]: r for r in got}
    assert by[0]["p"] < 0.01 and by[1]["p"] > 0.85 and by[1]["s"] > 2
    odd, c = toxicity.score_toxicity(odd_docs, model)
    assert odd.columns[:len(odd_docs.columns)] == odd_docs.columns and odd.filter(F.col(c["p_toxic"]) >= 0.5).count() == 0
    assert toxicity.score_toxicity(no_docs, model)[0].count() == 0
    none = toxicity.train(odd_docs, spark.createDataFrame([(1, None, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert {r[c["severity"]] for r in toxicity.score_toxicity(odd_docs, none)[0].withColumnRenamed("x", "y").select(F.lit(0.0).alias(c["severity"])).collect()} == {0.0}
    assert not none.weights


def test_ordinal_fit_orders_grades():
    rows = [(0, [], 50), (1, [0], 10), (1, [0, 1], 10), (1, [0, 1, 2, 3], 10), (0, [4], 5)]
    model = toxicity.fit(["a", "b", "c", "d", "e"], rows)
    severity = [sum(model.score(t)) for t in ("", "a", "a b", "a b c d")]
    assert severity == sorted(severity) and severity[0] < 0.5 < severity[1] and model.score("x")[0] == model.score("")[0]


def test_window_model_is_a_distribution_and_learns():
    texts = ["the cat sat on the mat and the dog sat on the rug"] * 200
    ids = {w: i for i, w in enumerate(sorted(set(" ".join(texts).split())))}
    rng = np.random.default_rng(1)
    model = pseudolm.WindowModel(ids, rng.normal(0, 0.1, pseudolm.SIZE).astype(np.float32))
    target, around = pseudolm.contexts([model.tokens(texts[0]), model.tokens(""), model.tokens("cat unseen-word")])
    assert len(target) == 15 and around[0].tolist() == [pseudolm.PAD, pseudolm.PAD, target[1], target[2]]
    assert around[13].tolist() == [pseudolm.PAD, pseudolm.PAD, target[14], pseudolm.PAD]
    every = np.arange(pseudolm.VOCABULARY)
    for row in (0, 5):
        lp = pseudolm.log_probabilities(model.w, every, np.repeat(around[row:row + 1], len(every), 0))
        assert np.exp(lp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    vector, n = pseudolm.improve(model, iter(texts * 10), 0)
    better = pseudolm.WindowModel(ids, vector)
    assert n > 0 and pseudolm.log_probabilities(better.w, target[:13], around[:13]).sum() > pseudolm.log_probabilities(model.w, target[:13], around[:13]).sum() + 5


def test_window_gradients():
    rng = np.random.default_rng(3)
    w = {k: rng.normal(0, 0.3, s) for k, s in pseudolm.SHAPES.items()}
    target, around = rng.integers(0, pseudolm.VOCABULARY, 40).astype(np.int32), rng.integers(0, pseudolm.PAD + 1, (40, 4)).astype(np.int32)
    g = pseudolm.gradients(w, target, around)

    def loss():
        x = w["E"][around].reshape(40, -1)
        h = np.tanh(x @ w["W"] + w["b"])
        k, p = target // pseudolm.PLACES, target % pseudolm.PLACES
        a = pseudolm._log_softmax(h @ w["C"] + w["c"])[np.arange(40), k]
        b = np.array([pseudolm._log_softmax((h[i] @ w["M"][k[i]] + w["m"][k[i]])[None])[0, p[i]] for i in range(40)])
        return -(a + b).mean()

    for k in pseudolm.SHAPES:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=2e-2, abs=1e-6)


def test_scores_of_odd_rows(odd_docs, no_docs):
    model = pseudolm.train(odd_docs)
    rows, c = pseudolm.score(odd_docs, model)
    assert rows.columns[:len(odd_docs.columns)] == odd_docs.columns
    for r in rows.collect():
        target, around = pseudolm.contexts([model.tokens(r["text"])])
        assert r[c["n_tokens"]] == len(target)
        assert r[c["log_prob"]] == pytest.approx(float(pseudolm.log_probabilities(model.w, target, around).astype(float).sum()), rel=1e-4, abs=1e-6)
    assert pseudolm.score(no_docs, pseudolm.train(no_docs))[0].count() == 0


def test_corpus_counts_cover_every_document(spark):
    docs = spark.createDataFrame([(i, f"Common word{i % 3} x") for i in range(50)], "doc_id bigint, text string").repartition(6)
    got = {r["word"]: r["n"] for r in pseudolm.word_counts(docs.select("text")).collect()}
    assert got == {"common": 50, "x": 50, "word0": 17, "word1": 17, "word2": 16}


def test_vocabulary_follows_the_corpus(spark):
    """Words beyond the first 768 are told apart, and words of one hash class share its probability by their counts."""
    small = [(i, f"a{i % 40} b{i % 40} a{i % 40}") for i in range(400)]
    large = [(i, f"w{i % 3000} v{i % 3000} w{i % 3000}") for i in range(6000)]
    sizes = []
    for rows in (small, large):
        model = pseudolm.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
        sizes.append((len(model.ids), len(model.vector)))
    assert sizes[0][0] == 80 and sizes[1][0] == 6000 and sizes[1][1] > 5 * sizes[0][1]
    assert len({int(model.tokens(w)[0]) for w in model.ids}) == 6000 and pseudolm.PAD not in model.ids.values()


def test_rare_words_share_their_class(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "SPARSE", 1)
    rows = [(i, f"c{i % 800} c{i % 800} c{i % 800}") for i in range(1600)] + [(2000 + i, f"r{i} " * (1 + i % 3)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pseudolm.train(docs)
    known = {}
    for _, t in rows:
        for w in t.split():
            if w not in model.ids:
                known[w] = known.get(w, 0) + 1
    classes = [0] * pseudolm.HASHED
    for w, n in known.items():
        classes[int(model.tokens(w)[0]) - (pseudolm.VOCABULARY - pseudolm.HASHED)] += n
    assert known and classes == model.class_counts
    odd = spark.createDataFrame(rows[-30:] + [(1, "r4 never-seen r4 c1"), (1, "r4 never-seen r4 c1"), (2, None)], "doc_id bigint, text string")
    got, c = pseudolm.score(odd, model)
    for r in got.collect():
        ids = model.tokens(r["text"])
        want = float(pseudolm.log_probabilities(model.w, *pseudolm.contexts([ids])).astype(float).sum())
        for w, i in zip((r["text"] or "").split(), ids.tolist()):
            if w not in model.ids:
                total = classes[i - (pseudolm.VOCABULARY - pseudolm.HASHED)]
                want += np.log(known[w] / total) if w in known else np.log(1 / (total + 1))
        assert r[c["log_prob"]] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_gradients_of_a_larger_vocabulary():
    rng = np.random.default_rng(5)
    shape = pseudolm.shapes(2000)
    w = {k: rng.normal(0, 0.3, s) for k, s in shape.items()}
    units = shape["m"][0] * shape["m"][1]
    every = np.array([i for i in range(units + 1) if i != pseudolm.PAD])
    around = rng.integers(0, units + 1, (1, 4)).astype(np.int32)
    assert np.exp(pseudolm.log_probabilities(w, every, np.repeat(around, units, 0)).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    target, around = rng.choice(every, 30).astype(np.int32), rng.integers(0, units + 1, (30, 4)).astype(np.int32)
    g = pseudolm.gradients(w, target, around)
    for k in shape:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for d in (1e-3, -2e-3):
            w[k][at] += d
            loss.append(-pseudolm.log_probabilities(w, target, around).astype(float).mean())
        w[k][at] += 1e-3
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(g[k][at], rel=5e-2, abs=1e-4)


def test_every_position_is_a_target():
    texts = ["a b c d e f g", "", "h", " ".join("abcdefgh"[i % 8] for i in range(1000))]
    model = pseudolm.WindowModel({w: i for i, w in enumerate("abcdefgh")}, np.random.default_rng(2).normal(0, 0.1, pseudolm.SIZE).astype(np.float32))
    for turn in (0, 1):
        assert pseudolm.improve(model, iter(texts), turn)[1] == 7 + 1 + 1000


def test_small_softmaxes_in_stacks(monkeypatch):
    """Classes of few rows are computed together, in few calls; dense softmaxes are the reference."""
    rng = np.random.default_rng(8)
    w = {k: rng.normal(0, 0.3, s) for k, s in pseudolm.shapes(1500).items()}
    side, n = w["c"].shape[0], 3000
    units = side * side
    target = np.where(rng.random(n) < 0.5, rng.integers(0, 20, n), rng.integers(0, units, n)).astype(np.int32)  # large groups and small ones
    target[target == pseudolm.PAD] += 1
    around = rng.integers(0, units + 1, (n, 4)).astype(np.int32)
    h = np.tanh(w["E"][around].reshape(n, -1) @ w["W"] + w["b"])
    kind, place = np.divmod(target - (target > pseudolm.PAD), side)
    large, small = pseudolm._stacks(kind)
    stacks = list(small)
    got = np.concatenate([rows for _, rows in large] + [rows[real] for _, rows, real in stacks])
    assert sorted(got.tolist()) == list(range(n)) and len(large) == 1 and len(stacks) < side / 3
    assert all((kind[rows[real]] == np.repeat(k, real.sum(1))).all() for k, rows, real in stacks)
    each = np.arange(n)
    for scale in (1, 400):  # the second needs the shift before exp
        w["m"] *= scale
        want = (pseudolm._log_softmax(h @ w["C"] + w["c"])[each, kind]
                + pseudolm._log_softmax(np.einsum("nh,nhp->np", h, w["M"][kind]) + w["m"][kind])[each, place])
        np.testing.assert_allclose(pseudolm.log_probabilities(w, target, around), want, rtol=1e-4, atol=1e-4)
    w["m"] /= 400
    g = pseudolm.gradients(w, target, around)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for d in (1e-2, -2e-2):
            w[k][at] += d
            loss.append(-pseudolm.log_probabilities(w, target, around).astype(float).mean())
        w[k][at] += 1e-2
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[k][at], rel=5e-2, abs=1e-5), k


def test_rare_words_are_passed_on_once(spark, monkeypatch):
    """A text's rare words come once each with their number, so that they need no grouping before they meet their counts."""
    monkeypatch.setattr(pseudolm, "SPARSE", 1)
    docs = spark.createDataFrame([(i, f"c{i % 800} c{i % 800} c{i % 800}") for i in range(1600)] + [(2000, "r1 r2 R1 c5 r1"), (2001, None), (2001, "c5")], "doc_id bigint, text string")
    model = pseudolm.train(docs)
    assert {"r1", "r2"}.isdisjoint(model.ids) and "c5" in model.ids
    rows = docs.filter("doc_id >= 2000").select("doc_id", pseudolm.pseudo_likelihood(model, F.col("text")).alias("lm")).collect()
    assert sorted((r["doc_id"], r["lm"]["n_tokens"], dict(zip(r["lm"]["rare"], r["lm"]["times"]))) for r in rows if r["lm"]["rare"]) == [(2000, 5, {"r1": 3, "r2": 1})]
    plan = pseudolm.score(docs, model)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the shares of a row


def test_logits_are_shifted_where_sums_need_it():
    """Sums of exp decide about the shift; parts of a call are of one size, so no result hangs on the parts."""
    rng = np.random.default_rng(4)
    w = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in pseudolm.shapes(1500).items()}
    h, at = np.tanh(rng.normal(size=(5000, pseudolm.HIDDEN))).astype(np.float32), rng.integers(0, len(w["c"]), 5000)
    for add in (0, 95, -95, 400, -400):
        bias = w["c"] + np.float32(add)
        z, total, own = pseudolm._exp_logits(h, w["C"], bias, at)
        assert np.isfinite(total).all() and (total > 0).all()
        want = pseudolm._log_softmax((h @ w["C"] + bias).astype(float))[np.arange(5000), at]
        np.testing.assert_allclose(own - np.log(total), want, atol=2e-4)
        np.testing.assert_allclose(z.sum(1), total, rtol=1e-4)
