import math
import random
import zlib

import numpy as np

from cellgrain.llm import toxicity

from .conftest import make


def corpus(n=1500, seed=4):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(draw.randint(5, 80))]
        toxic = draw.random() < 0.15
        if toxic:
            for _ in range(draw.randint(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(["idiot", "scum,", "Moron!", "zorgblat" + draw.choice("xyz")]))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scores(make(spark, rows), table).collect()}
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    marks = []
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and i in truth:
            marks.append((truth[i], r["predicted"]))
    assert sum(y == p for y, p in marks) / len(marks) > 0.98


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows, labels = corpus()
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.train(make(spark, rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias


def test_edges(spark, edges, empty):
    rows, labels = corpus(600)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.scores(edges, table).collect())
    assert toxicity.scores(edges, none).count() == edges.count() and toxicity.scores(empty, table).count() == 0
    docs = make(spark, [(1, "you are an idiot and a moron"), (2, "a kind word"), (3, None)])
    kept = toxicity.reject(docs, none)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_label_model_finds_rates_and_correlations():
    draw = np.random.default_rng(1)
    y = draw.random(4000) < 0.2
    votes = (draw.random((4000, 4)) < np.where(y[:, None], [0.7, 0.6, 0.5, 0.0], [0.01, 0.02, 0.01, 0.0])).astype(float)
    votes[:, 3] = votes[:, 0] * (draw.random(4000) < 0.95)  # says what voter 0 says
    post, rate, corr = toxicity.label_model(votes, y.astype(int), 0.2)
    assert np.mean((post > 0.5) == y) > 0.98
    assert abs(rate[1, 0] - 0.7) < 0.05 and corr[0, 3] > 0.5 and abs(corr[0, 1]) < 0.2


def test_patterns_are_looked_at_where_an_insult_has_no_weight():
    model = toxicity.Model({"=moron": 4.0, "?you": 3.0, "?shout": 2.0}, -3.0)
    for text, patterns in (("you are so vile", 3.0), ("VILE!", 2.0), ("a vile thing", 0.0), ("you are so kind", 0.0)):
        assert abs(model.score(text) - 1 / (1 + np.exp(3.0 - patterns))) < 1e-12


def plain_label_model(votes, said, prior, weight, rounds=80):
    """The label model of ``toxicity`` in loops over texts and voters."""
    n, k = len(votes), len(votes[0])
    post = [(0.9 if any(v) else 0.4) if s else 0.05 for v, s in zip(votes, said)]
    share, clip = [1.0] * k, lambda x, low: min(max(x, low), 1 - low)
    for step in range(rounds):
        total = [sum(w * (1 - p) for w, p in zip(weight, post)), sum(w * p for w, p in zip(weight, post))]
        belief = [[1 - p for p in post], post]

        def rate_of(fires, smooth, low):
            return [clip((sum(w * b * f for w, b, f in zip(weight, belief[c], fires)) + smooth[c]) / (total[c] + 1), low) for c in (0, 1)]

        rate = [rate_of([v[j] for v in votes], (0.05, 0.1), 1e-6) for j in range(k)]
        label = rate_of([s == 1 for s in said], (0.1, 0.9), 1e-4)
        new = []
        expected = sum(share[j] * (rate[j][1] - rate[j][0]) for j in range(k))
        for v, s in zip(votes, said):
            z = sum(share[j] * math.log(rate[j][1] / rate[j][0]) for j in range(k) if v[j]) - expected
            z += math.log(label[1] / label[0]) if s else math.log((1 - label[1]) / (1 - label[0]))
            new.append(1 / (1 + math.exp(-clip_at_30(z + math.log(prior / (1 - prior))))))
        prior = clip((sum(w * p for w, p in zip(weight, new)) + 0.5) / (sum(weight) + 1), 1e-4)
        if step in (5, 15):
            left = [[v[j] - p * rate[j][1] - (1 - p) * rate[j][0] for j in range(k)] for v, p in zip(votes, new)]
            all_ = sum(weight)
            scale = [math.sqrt(sum(w * x[j] ** 2 for w, x in zip(weight, left)) / all_) + 1e-9 for j in range(k)]
            for i in range(k):
                corr = [sum(w * x[i] * x[j] for w, x in zip(weight, left)) / all_ / scale[i] / scale[j] for j in range(k) if j != i]
                share[i] = 1 / (1 + sum(c for c in corr if c > 0.2))
        done = step > 16 and max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        post = new
        if done:
            break
    return post, label


def clip_at_30(z):
    return min(max(z, -30.0), 30.0)


def noisy(seed, n=600, wrong=0.08):
    """Votes of six voters, true classes, and labels of which some are wrong."""
    draw = np.random.default_rng(seed)
    y = (draw.random(n) < 0.3).astype(int)
    votes = (draw.random((n, 6)) < np.where(y[:, None] == 1, [0.7, 0.6, 0.5, 0.6, 0.4, 0.0], [0.02, 0.03, 0.01, 0.02, 0.05, 0.0])).astype(float)
    votes[:, 5] = votes[:, 0] * (draw.random(n) < 0.9)
    return votes, y, np.where(draw.random(n) < wrong, 1 - y, y)


def test_label_model_is_that_of_plain_loops():
    votes, _, said = noisy(3, 80)
    weight = np.arange(80) % 3 + 1.0
    post, rate, _ = toxicity.label_model(votes, said, 0.3, weight)
    want, label = plain_label_model(votes.tolist(), said.tolist(), 0.3, weight.tolist())
    assert np.allclose(post, want, atol=1e-6) and np.allclose(rate[:, -1], label, atol=1e-6)


def test_wrong_labels_are_found_and_outvoted():
    """The annotator's errors are estimated, and posteriors are right where labels are not."""
    votes, y, said = noisy(7, 4000)
    post, rate, _ = toxicity.label_model(votes, said, said.mean())
    assert abs(rate[1, -1] - 0.92) < 0.02 and 0.02 < rate[0, -1] < 0.1
    wrong = said != y
    assert np.mean((post > 0.5)[wrong] == y[wrong]) > 0.7  # the labels have none of these
    assert np.mean((post > 0.5) == y) > np.mean(said == y) + 0.04


def test_posteriors_train_a_better_classifier_than_noisy_labels(spark):
    """With a quarter of the toxic labels missing, held-out texts are still told; labels in place of posteriors do worse."""
    rows, labels = corpus(3000, 9)
    truth = {i: y for i, _, y in labels}
    draw = random.Random(2)
    bad = [(i, q, 0 if y and draw.random() < 0.4 else y) for i, q, y in labels]
    docs, table = make(spark, rows), spark.createDataFrame(bad, "doc_id long, quality int, toxic int")

    def errors():
        model = toxicity.train(docs, table)
        held = [(model.score(t) >= 0.3, truth[i]) for i, t in rows if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
        return sum(p != bool(y) for p, y in held), np.mean([abs(model.score(t) - truth[i]) for i, t in rows if i in truth])

    ours, ours_off = errors()
    supervised = toxicity.label_model
    try:
        toxicity.label_model = lambda votes, said, prior, weight=None: (said.astype(float), *supervised(votes, said, prior, weight)[1:])
        theirs, theirs_off = errors()
    finally:
        toxicity.label_model = supervised
    assert ours <= theirs and ours_off < 0.7 * theirs_off


def test_an_id_of_very_many_rows_gives_one_text(spark):
    rows, labels = corpus(600)
    docs = make(spark, rows + [(1, f"row {i} of a hot id") for i in range(3000)])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.scores(docs, table).collect()]
    assert len(held) == len(rows) + 3000 and not any(r["predicted"] for r in held if r["doc_id"] == 1 and r["score"] < 0.3)


def test_patterns_of_all_languages():
    for text, name in (("shut up now", "?silence"), ("Ta gueule.", "?silence"), ("ich bring dich um", "?threat"), ("so ein Trottel", "?called"), ("eres basura", "?you_es"), ("tu es un salaud", "?you_fr"), ("idiot, moron", "?pair")):
        words = [w for w in toxicity._WORD.findall(text.lower())]
        assert name in toxicity.fired(text, words), text
    assert toxicity.fired("a kind word to you", "a kind word to you".split()) == []
