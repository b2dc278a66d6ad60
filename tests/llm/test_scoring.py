import random

import numpy as np

from pyspark.sql import functions as F

from tessera.llm import langid, toxicity


def test_language_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_defined_cases(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !? 4", "en"), (-4, "the and of " * 50_000, None), (None, "the words are of that", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(odd.selectExpr("*", "1 AS score", "'x' AS lang_pred"), docs).collect()}
    assert [got[k].lang_pred for k in (-1, -2, -3)] == ["und"] * 3 and [got[k].score for k in (-1, -2, -3)] == [0.0] * 3
    assert got[-4].lang_pred == "en" and got[None].lang_pred == "en" and not got[None].held_out
    assert {r.lang_pred for r in langid.predict(odd.filter("lang IS NULL")).collect()} == {"und"}
    assert langid.predict(odd.limit(0)).count() == 0
    assert {r.doc_id for r in langid.keep_known(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}.isdisjoint({-1, -2, -3})


def test_every_language_is_learned(spark):
    rng, rows, many = random.Random(3), [], langid.FULL_LANGS + 16
    for k in range(many):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=20)), f"l{k:02}") for i in range(8 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {i: lang for i, _, lang in rows}
    got = langid.predict(docs).collect()
    assert len({r.lang_pred for r in got}) == many and all(r.lang_pred == told[r.doc_id] for r in got)


def test_short_clean_texts_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    words = sorted({w for r in docs.collect() for w in (r.text or "").split()[:3] if w.isalpha()})
    short = spark.createDataFrame([(10_000 + i, w, None) for i, w in enumerate(words)] + [(-1, "Привет, как дела? Всё хорошо, спасибо. А у тебя что нового сегодня?", None)], docs.schema)
    assert langid.predict(short, docs).filter(F.col("score") < langid.REJECT).count() > 1
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(short)).collect()}
    assert {10_000 + i for i in range(len(words))} <= kept and -1 not in kept


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0)
    got = toxicity.severity(docs, train).join(labels.withColumnRenamed("toxic", "told").join(train.select("doc_id"), "doc_id", "left_anti"), "doc_id").collect()
    wrong = sum(r.told != r.toxic for r in got)
    assert wrong <= 0.06 * len(got)
    assert sum(r.toxic and not r.told for r in got) <= 2


def test_toxicity_defined_cases(spark):
    words = ["the of and in that", "a house by the sea", "rain fell on the road"]
    rows = [(i, f"{words[i % 3]} {'idiot scum ' * (1 + i % 5) if i % 2 else ''}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None), (101, ""), (None, "you idiot scum"), (1, rows[1][1])], "doc_id long, text string").selectExpr("*", "0 AS severity", "'x' AS toxic")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(60)], (None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    got = toxicity.severity(docs, labels).collect()
    assert len(got) == 64
    at = {r.doc_id: r for r in got}
    assert not at[100].toxic and not at[101].toxic and at[None].toxic
    assert all(at[i].toxic == bool(i % 2) for i in range(60))
    assert {r.severity for r in toxicity.severity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.severity for r in toxicity.severity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.severity(docs.limit(0), labels).count() == 0


def ordinal_data(n=400, width=6, levels=3, seed=1):
    rng = np.random.default_rng(seed)
    dense = rng.poisson(0.7, (n, width)).astype(float)
    rows, places = np.nonzero(dense)
    score = dense @ np.array([2.0, 1.0, 0.0, -1.0, 0.5, 0.0])[:width]
    grades = (score[:, None] + rng.logistic(size=(n, 1)) > np.array([0.5, 2.0, 3.5])[:levels]).sum(axis=1)
    return rows, places, dense[rows, places], grades, dense


def test_ordinal_gradient_by_finite_differences():
    rows, places, values, grades, dense = ordinal_data()
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 0.5, dense.shape[1]), [0.2, -0.3, 0.4]])
    value, gradient = toxicity.likelihood(p, rows, places, values, grades, dense.shape[1])
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-5
        up, down = (toxicity.likelihood(p + s, rows, places, values, grades, dense.shape[1])[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-6


def test_ordinal_fit_recovers_weights_and_thresholds():
    rows, places, values, grades, dense = ordinal_data(n=6000)
    weights, thresholds = toxicity.fit_ordinal(rows, places, values, grades, dense.shape[1], 3)
    assert np.abs(weights - [2.0, 1.0, 0.0, -1.0, 0.5, 0.0]).max() < 0.2 and np.abs(thresholds - [0.5, 2.0, 3.5]).max() < 0.25
    over = toxicity.sigmoid((dense @ weights)[:, None] - thresholds)
    true = toxicity.sigmoid((dense @ np.array([2.0, 1.0, 0.0, -1.0, 0.5, 0.0]))[:, None] - np.array([0.5, 2.0, 3.5])).sum(axis=1)
    assert (np.diff(over, axis=1) <= 0).all() and np.abs(over.sum(axis=1) - true).max() < 0.15


def test_string_kernel_with_all_texts_as_landmarks_is_exact_ridge(spark):
    """Kernel, landmarks and dual against plain sets of n-grams and the normal equations."""
    rng, rows = random.Random(5), []
    for i in range(24):
        words = {"aa": ["der", "und", "nicht", "ein"], "bb": ["the", "of", "and", "that"], "cc": ["les", "que", "dans", "une"]}
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rng.choices(words[lang], k=3)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    grams = {i: {(" " + t + " ")[a : a + n] for n in (1, 2, 3) for a in range(len(t) + 3 - n)} for i, t, _ in rows}
    train = list({(t, lang): i for i, t, lang in reversed(rows) if not got[i].held_out}.values())
    kernel = lambda a, b: len(grams[a] & grams[b]) / (len(grams[a]) * len(grams[b])) ** 0.5
    k = np.array([[kernel(a, b) for b in train] for a in train])
    lang_of = {i: lang for i, _, lang in rows}
    names = sorted(set(lang_of.values()))
    target = np.array([[lang_of[i] == x for x in names] for i in train], dtype=float)
    weight = (1 / target.sum(axis=0))[target.argmax(axis=1)] * len(train) / len(names)
    dual = np.linalg.solve(k.T @ (k * weight[:, None]) + langid.RIDGE * len(train) * k + 1e-8 * np.eye(len(train)), k.T @ (target * weight[:, None]))
    for i in got:
        scores = np.array([kernel(i, b) for b in train]) @ dual
        assert got[i].lang_pred == names[int(scores.argmax())] and abs(got[i].score - min(1, max(0, scores.max()))) < 1e-3
