"""Toxicity, quality and language: held-out accuracy, method properties and awkward input."""

import random
import zlib

import numpy as np
import pytest

from tracequery.llm import language_id, quality, toxicity


def held(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


@pytest.fixture(scope="module")
def sample(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_kernel_tolerates_gaps_and_insertions():
    k = toxicity.kernel
    assert k("idiot", "idiot") == pytest.approx(1)
    assert k("idiot", "idxiot") > 3 * k("idiot", "statue") and k("idiot", "idiiot") > 0.5
    brute = {}
    for s in ("abca",):
        c = [0, *(ord(x) - 96 for x in s), 0]
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for m in range(j + 1, len(c)):
                    if m - i <= toxicity.REACH:
                        key = c[i] << 12 | c[j] << 6 | c[m]
                        brute[key] = brute.get(key, 0) + toxicity.DECAY ** (m - i + 1)
    (_, codes, w, norms), = toxicity.subsequences(["abca"])
    got = np.bincount(codes[0], w, toxicity._CODES)
    assert {int(i): pytest.approx(got[i]) for i in np.flatnonzero(got)} == brute
    assert norms[0] == pytest.approx(sum(v * v for v in brute.values()) ** 0.5)


def test_strings_of_tokens():
    assert toxicity.strings_of("i.d.i.o.t!") == ["idiot"]
    assert toxicity.strings_of("123") == [] and toxicity.strings_of("***") == [] and toxicity.strings_of("ab") == ["ab"]
    assert all(len(s) <= toxicity.LONGEST for s in toxicity.strings_of("x" * 1000))
    assert toxicity.spaced_out("you i d i o t now a b".split()) == ["idiot"]


def test_toxicity_held_out(sample):
    docs, labels = sample
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(i, 5, 0) for i, r in got.items())
    rows = [r for r in labels.collect() if held(r.doc_id, 5, 0)]
    right = np.mean([got[r.doc_id].predicted == r.toxic for r in rows])
    assert right >= 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_held_out(sample):
    docs, labels = sample
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    rows = [r for r in labels.collect() if held(r.doc_id, 4, 2)]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in rows]) >= 0.9
    assert all(r.held_out == held(i, 4, 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())


def test_temperature_and_vectors():
    rng = np.random.default_rng(0)
    z = rng.standard_normal(4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    assert 2.2 < quality.fit_temperature(3 * z, y) < 4
    pos, sign = quality.index_vectors(["a", "b"])
    assert pos.shape == (2, quality.NONZERO) and set(np.unique(sign)) <= {-1.0, 1.0} and len(set(pos[0])) == quality.NONZERO


def test_language_held_out(sample):
    docs, _ = sample
    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    rows = [r for r in docs.collect() if held(r.doc_id, 5, 0)]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) >= 0.95


def test_codewords_and_decoding():
    for n in (2, 3, 5, 7, 12):
        m = language_id.codewords(n)
        d = (m[:, None] != m[None]).sum(2)
        assert m.shape[0] == n and d[~np.eye(n, dtype=bool)].min() >= 1 and (np.abs(m.sum(0)) < n).all()
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcde ") for _ in range(80)) for _ in range(30)] + ["".join(rng.choice("vwxyz ") for _ in range(80)) for _ in range(30)] + ["".join(rng.choice("klmno ") for _ in range(80)) for _ in range(30)]
    model = language_id.fit([language_id.ngram_features(t) for t in texts], ["a"] * 30 + ["v"] * 30 + ["k"] * 30)
    assert model.predict("abc deab cde")[0] == "a" and model.predict("vwx yzvw")[0] == "v"
    assert model.predict("") == model.predict(None) == model.predict("12 !") == ("und", 0.0, True)
    assert model.decode(np.zeros(model.codes.shape[1]))[2]


def test_awkward_documents(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, 0, 1), (9, 1, 0), (9, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for out in (toxicity.score_toxicity(awkward, labels), quality.score_quality(awkward, labels), toxicity.score_toxicity(awkward, none), quality.score_quality(awkward, none)):
        assert out.count() == awkward.count()
    langs = language_id.identify_languages(awkward).collect()
    assert len(langs) == awkward.count() and {r.doc_id: r.lang_pred for r in langs}[12] == "und"
    assert toxicity.score_toxicity(no_docs, none).collect() == [] and quality.score_quality(no_docs, none).collect() == []
    assert language_id.identify_languages(no_docs).collect() == [] and toxicity.drop_toxic(no_docs, none).collect() == []
    assert toxicity.drop_toxic(awkward, none).columns == awkward.columns


def test_sums_over_pairs_of_words_equal_the_kernel_s():
    rng = np.random.default_rng(3)
    texts = ["you are a mo ron, go  on; x9y", "", "aaa aaa aaa bb", "one", "no é à ü zoë ß", "w" * 60 + " short pair"]
    pairs, weights = toxicity.Pairs.of(texts), rng.standard_normal(toxicity._CODES)
    exact = pairs.exact(np.arange(len(pairs.start)), weights)
    raw = pairs.sums(weights)
    for i, text in enumerate(texts):
        want = []
        for p in toxicity.word_pairs(text):
            (_, codes, w, norms), = toxicity.subsequences([p])
            want.append(float((weights[codes] @ w)[0] / norms[0]))
        assert sorted(set(exact[pairs.owner == i].round(9))) == pytest.approx(sorted(want))
        assert pairs.best(weights, len(texts))[i] == pytest.approx(max([0.0, *want]))
    sizes = pairs.end - pairs.start
    brute = [float((weights[toxicity._codes_of(pairs.sequence[a:b][None].astype(np.int64))[0]] @ toxicity.triples(n)[1])[0]) for a, b, n in zip(pairs.start, pairs.end, sizes)]
    assert raw == pytest.approx(brute)


def words(rng, n, letters="abcdefghijklmnoprstuw"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n)]


def test_phrases_and_cut_insults_are_toxic(spark):
    rng = random.Random(4)
    vocabulary = words(rng, 300)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            # Half of the toxic documents hold one bad word, half a phrase of two words that are clean apart.
            text[20:20] = ["zyxvquz"] if i % 2 else ["velvet", "hammer"]
        else:
            text[5:5], text[30:30] = ["velvet"], ["hammer"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    clean = [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(60)]
    cut = [(2000 + i, " ".join([*(rng.choice(vocabulary) for _ in range(20)), rng.choice(["zyx vquz", "zyxv quz", "zy xvquz", "zyxxvquz", "z.y.x.v.q.u.z", "zyxvq1uz"]), *(rng.choice(vocabulary) for _ in range(20))])) for i in range(60)]
    phrase = [(3000 + i, " ".join([*(rng.choice(vocabulary) for _ in range(20)), "velvet hammer", *(rng.choice(vocabulary) for _ in range(20))])) for i in range(30)]
    docs = spark.createDataFrame(rows + clean + cut + phrase, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, known).collect()}
    assert np.mean([got[i] for i, _ in clean]) <= 0.05 and np.mean([got[i] for i, _ in cut]) >= 0.9 and np.mean([got[i] for i, _ in phrase]) >= 0.9


def long_documents(n):
    """Texts of over 20,000 characters, whose label shows in some words of every part."""
    rng = random.Random(9)
    common = words(rng, 400, "abcdefgh")
    return [(i, " ".join(rng.choice(common) if rng.random() < 0.97 else rng.choice(["quartz", "quorum"] if i % 2 else ["zenith", "zephyr"]) for _ in range(5000)), ["aa", "bb"][i % 2]) for i in range(n)]


def test_long_texts_alone_are_learned_from(spark):
    docs = spark.createDataFrame(long_documents(60), "doc_id long, text string, lang string")
    assert docs.selectExpr("min(length(text)) > 20000").first()[0]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for out in (toxicity.score_toxicity(docs, labels), quality.score_quality(docs, labels)):
        got = out.collect()
        assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in got]) >= 0.95
    assert all(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in language_id.identify_languages(docs).collect())


def test_samples_are_whole_bounded_and_the_same_again(spark):
    from tracequery.llm.common import class_sample, excerpt
    from pyspark.sql import functions as F

    # One id on two thirds of the rows, its texts all alike or all unlike; one rare class.
    rows = [(7, "hot text", "a")] * 300 + [(8, f"text {i}", "a") for i in range(300)] + [(100 + i, f"other {i}", "b") for i in range(280)] + [(900, "rare", "c"), (None, "no id", "a"), (901, None, "c"), (902, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    first = sorted(map(tuple, class_sample(docs, "cls", 50).collect()))
    assert first == sorted(map(tuple, class_sample(docs.repartition(7), "cls", 50).collect()))
    assert {c: sum(r[1] == c for r in first) for c in "abc"} == {"a": 50, "b": 50, "c": 1}
    assert sum(r[2] == 7 for r in first) <= 1
    few = class_sample(docs, "cls", 50, total=9).groupBy("cls").count().collect()
    assert {r.cls: r["count"] for r in few} == {"a": 3, "b": 3, "c": 1}
    known = spark.createDataFrame([(8, 1), (8, 1), (100, 0), (5000, 0)], "doc_id long, label int")
    got = class_sample(docs.drop("cls"), "label", 20, known).collect()
    assert sorted((r.label, r.doc_id) for r in got) == [(0, 100)] + [(1, 8)] * 20
    text = " ".join(map(str, range(9000)))
    part = spark.createDataFrame([(text, 5)], "t string, k long").select(excerpt(F.col("t"), F.col("k"), 4000)).first()[0]
    pieces = [part[i * 501 : i * 501 + 500] for i in range(8)]
    assert len(part) == 8 * 500 + 7 and all(len(text) / 8 * i <= text.index(p) < len(text) / 8 * (i + 1) for i, p in enumerate(pieces))


def test_three_hundred_languages(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7))
        rows += [(k * 10 + j, " ".join(words(rng, 60, letters)), f"l{k:03}") for j in range(5)]
    got = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert all(r.lang_pred != "und" for r in got) and len({r.lang_pred for r in got}) > 250
    assert np.mean([r.lang_pred == f"l{r.doc_id // 10:03}" for r in got]) > 0.8


def test_quality_forward_pass_equals_plain_loops():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "fine,", "Text", "12", "bad!!", "bad", "SPAM"][: 4 if i % 2 else 7]) for _ in range(30)) for i in range(40)]
    model = quality.fit(texts, [i % 2 for i in range(40)])
    w1, b1, w2, b2 = model.layers
    got = model.scores([model.pooled(t) for t in texts])
    for text, score in zip(texts, got):
        ids = []
        tokens = text.split()
        for t in tokens:
            ids += [model.ids.get(i, model.ids["<rare>"]) for i in quality.items_of(t)]
        ids += [model.ids[quality.REPEAT]] * sum(a == b for a, b in zip(tokens, tokens[1:]))
        v = [model.vectors[i].astype(float) for i in ids]
        mean = sum(v) / len(v)
        spread = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5
        x = (np.concatenate([mean, spread]) - model.center) / model.scale
        z = sum(np.tanh(sum(x[i] * w1[i, j] for i in range(len(x))) + b1[j]) * w2[j] for j in range(len(b1))) + b2[0]
        assert score == pytest.approx(1 / (1 + np.exp(-z / model.temperature)), abs=1e-4)


def test_language_decoding_equals_plain_loops():
    codes = language_id.codewords(5)
    rng = np.random.default_rng(1)
    trust = rng.random(codes.shape)
    model = language_id.LanguageModel(list("vwxyz"), codes, np.zeros((1, 1)), trust)
    for _ in range(50):
        margins = rng.standard_normal(codes.shape[1])
        loss = [sum(trust[k, j] * np.exp(-2 * codes[k, j] * margins[j]) for j in range(len(margins))) for k in range(5)]
        assert model.decode(margins)[0] == "vwxyz"[int(np.argmin(loss))]
