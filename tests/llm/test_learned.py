"""Quality, toxicity and language: held-out accuracy and awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents
from wayline.llm import langid, quality, sums, toxicity

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def truth(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_language_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    found = langid.op8_langid(spark, SF).collect()
    assert len(found) == len(langs) and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"]]
    assert np.mean(held) > 0.98


def brute_grams(text):
    out = []
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f" {word} "
            out += [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip()]
            word = ""
    return out


@pytest.mark.parametrize("text", ["Hello, wörld! a", "", None, "x", "12 34", "ab1cd\U0001d49cz", "  The  the\nTHE "])
def test_grams_match_brute_force(text):
    def name(key):
        out = ""
        while key:
            out, key = chr(key & 0x1FFFFF) + out, key >> 21
        return out

    assert sorted(name(k) for k in langid.gram_keys(text).tolist()) == sorted(g for g in brute_grams(text) if not (len(g) == 3 and g[1] == " "))


def test_out_of_place_distance():
    a, b = np.array([1, 2, 3]), np.array([3, 2, 9])
    p = langid.Profiles({"a": a, "b": b}, 3)
    assert p.ranks.shape == (5, 2)
    keys = langid.ranked(np.array([2, 2, 3, 3, 3, 7]), 3)
    assert keys.tolist() == [3, 2, 7]


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_languages(spark, extra):
    docs = documents(spark, AWKWARD, extra)
    found = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    assert langid.identify_languages(docs).count() == len(AWKWARD)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 6))
    kept = langid.keep_known_languages(docs)
    assert kept.columns == docs.columns and {1, 2, 3, 6}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify_languages(documents(spark, [])).count() == 0
    nothing = documents(spark, [(1, "words", None, None)])
    assert langid.identify_languages(nothing).first()["lang_pred"] == "und"


def test_quality_held_out(spark, truth):
    found = quality.op4_quality(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r["predicted"] == truth[r["doc_id"]]["quality"] for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(held) > 0.95
    kept = {r["doc_id"] for r in quality.keep_good(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id").collect()}
    good = [i for i, r in truth.items() if r["quality"] == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_quality(spark, extra):
    docs = documents(spark, AWKWARD, extra)
    for labels, wanted in (([], 1.0), ([(i, 0, 0) for i in range(1, 10)], 0.0), ([(7, 1, None), (8, None, 1), (None, 0, 1)], None)):
        found = quality.score_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
        assert wanted is None or {r["score"] for r in found} == {wanted}
    mixed = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)], LABELS)
    assert quality.score_quality(docs, mixed).count() == len(AWKWARD)
    assert quality.keep_good(docs, mixed).columns == docs.columns
    assert quality.score_quality(documents(spark, []), mixed).count() == 0


def test_views_are_separate():
    """No word changes the metadata view, no language, source or line length the content view."""
    a, b = "aaaa bbb\n\ncc dd", "zzzz qqq\n\nxx yy"
    assert (quality.metadata_view(a, "en", "s") == quality.metadata_view(b, "en", "s")).all() and (quality.content_view(a) != quality.content_view(b)).any()
    assert (quality.metadata_view(a, "de", "s") != quality.metadata_view(a, "en", "s")).any() and quality.content_view(None).shape == (quality.CONTENT,)


def newton_logistic(x, y, weight, l2, start):
    """One damped Newton step of a weighted logistic regression, row by row."""
    a = np.c_[x, np.ones(len(x))]
    shrink = np.r_[np.full(x.shape[1], l2), 1e-6]
    g, h = shrink * start, np.diag(shrink)
    for row, target, w in zip(a, y, weight, strict=True):
        p = 1 / (1 + np.exp(-row @ start))
        g = g + w * (p - target) * row
        h = h + w * max(p * (1 - p), 1e-4) * np.outer(row, row)
    return start - np.clip(np.linalg.solve(h, g), -quality.LONGEST, quality.LONGEST)


def test_co_training_matches_brute_force(spark):
    """All rounds on a small table again by plain numpy over all rows at once: the same models, the same scores."""
    rng = np.random.default_rng(7)
    good, bad = ["river", "stone", "light", "wind", "tree"], ["click", "buy!!!", "$$$", "win", "$9"]
    rows = []
    for i in range(240):
        is_bad = i % 3 == 0
        words = rng.choice(bad if is_bad else good, 12).tolist() + rng.choice(good + bad, 2).tolist()
        rows.append((i, "\n".join([" ".join(words)] * (1 + 3 * is_bad)), "en", "web" if is_bad ^ (rng.random() < 0.02) else "book", 0, int(not is_bad)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(r[0], r[5], 0) for r in rows if r[0] % 2 == 0]
    frame = spark.createDataFrame(labels, LABELS)
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, frame).collect()}
    xs = [np.stack([quality.content_view(r[1]) for r in rows]).astype(np.float16).astype(float), np.stack([quality.metadata_view(*r[1:4]) for r in rows]).astype(np.float32).astype(float)]
    known = [i for i, _, _ in labels if fold(i, 5) != 0]
    back = [i for i in known if zlib.crc32(f"calibrate {i}".encode()) % quality.CALIBRATION == 0]
    train = [i for i in known if i not in back]
    y = np.array([r[5] for r in rows], float)
    floors = [np.r_[np.full(quality.BUCKETS, 0.25), np.full(quality.CONTENT - quality.BUCKETS, 1e-3)], 1e-3]
    zs = [(x - x[known].mean(0)) / np.maximum(x[known].std(0), floor) for x, floor in zip(xs, floors, strict=True)]
    from wayline.llm.linear import fit_logistic

    models = [fit_logistic(z[train], y[train], l2=quality.L2) for z in zs]
    margin = lambda v: zs[v] @ models[v][:-1] + models[v][-1]
    platt = lambda: [fit_logistic(margin(v)[back][:, None], y[back], l2=0.01) for v in (0, 1)]
    others, given = [i for i in range(240) if fold(i, 5) != 0 and i not in known], 0
    for _ in range(quality.ROUNDS):
        cal = platt()
        sure = [1 / (1 + np.exp(-(margin(v) * cal[v][0] + cal[v][1]))) for v in (0, 1)]
        told = [{label: [i for i in others if (sure[1 - v][i] if label else 1 - sure[1 - v][i]) >= quality.SURE] for label in (0, 1)} for v in (0, 1)]
        given += sum(len(x) for t in told for x in t.values())
        have = [(y[train] == label).sum() for label in (0, 1)]
        models = [np.zeros_like(m) for m in models]
        for _ in range(quality.NEWTON):
            fresh = []
            for v in (0, 1):
                use, target, weight = list(train), list(y[train]), [1.0] * len(train)
                share = min(quality.WEIGHT, *(len(told[v][label]) / have[label] for label in (0, 1)))
                for label, ids in told[v].items():
                    use += ids
                    target += [float(label)] * len(ids)
                    weight += [share * have[label] / max(len(ids), 1)] * len(ids)
                fresh.append(newton_logistic(zs[v][use], target, weight, quality.L2, models[v]))
            models = fresh
    cal = platt()
    both = np.stack([margin(v) * cal[v][0] + cal[v][1] for v in (0, 1)], 1)
    w = fit_logistic(both[back], y[back], l2=0.1)
    wanted = 1 / (1 + np.exp(-(both @ w[:-1] + w[-1])))
    assert given > 0 and max(abs(found[i] - wanted[i]) for i in range(240)) < 1e-6


def test_sums_of_a_step_follow_the_cores(spark, monkeypatch):
    """However many partitions: two vectors a core at most, each with half of the curvature, and few for the driver."""
    cores, seen = spark.sparkContext.defaultParallelism, []

    def counted(parts, *tasks):
        seen.append((parts.count(), len(parts.first()["vector"]) // 8, *tasks))
        return sums.total(parts, *tasks)

    monkeypatch.setattr(quality, "total", counted)
    text = F.concat(F.when(F.col("id") % 2 == 0, "good words ").otherwise("bad lines "), F.col("id"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"))
    quality.co_train(quality.features(docs.repartition(2 * cores + 7)), labels, rounds=1)
    sizes = [quality.CONTENT + 1, quality.META + 1]
    assert len(seen) == quality.NEWTON and all(n <= 2 * cores and size <= sum(d * d + 3 * d + 2 for d in sizes) for n, size, *_ in seen)
    square = np.array([[1.0, 2, 3], [2, 4, 5], [3, 5, 6]])
    assert (sums.symmetric(sums.upper(square), 3) == square).all()


def test_toxicity_held_out(spark, truth):
    found = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    hits = sum(p and t for p, t in held)
    assert hits / sum(p for p, _ in held) > 0.95 and hits / sum(t for _, t in held) > 0.85


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, other))
    assert a.weights == b.weights and a.intercept == b.intercept


def brute_nnpu(p, u, prior, steps=toxicity.STEPS, rate=toxicity.RATE):
    """The same descent by plain numpy over whole matrices."""
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        bracket = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        rise = su @ u / len(u) - prior * (sp @ p) / len(p)
        g = -rise if bracket < 0 else prior * ((sp - 1) @ p) / len(p) + rise + np.r_[np.full(len(w) - 1, toxicity.SHRINK), 0] * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_risk_is_corrected_for_the_prior(spark):
    """Unlabelled data of which a known share is positive: the scorer tells the classes apart at 0, and is the one that
    the same descent over whole matrices ends at."""
    rng = np.random.default_rng(3)
    draw = lambda n, toxic: (rng.random((n, 4)) < (0.95, 0.8, 0.3, 0.05)).astype(float) if toxic else (rng.random((n, 4)) < (0.03, 0.05, 0.3, 0.6)).astype(float)
    p, u = draw(400, True), np.r_[draw(300, True), draw(700, False)]
    rows = [(int(k), [int(i) for i in np.flatnonzero(x)], [1.0] * int(x.sum())) for k, part in ((1, p), (0, u)) for x in part]
    both = spark.createDataFrame([r for r in rows if r[1]], "positive int, at array<int>, value array<float>").repartition(5)
    # Here the confirmed are among all documents, as in `train`.
    found = toxicity.fit(both, 4, len(p), len(p) + len(u), 0.5)
    wanted = brute_nnpu(p, np.r_[p, u], 0.5)
    assert np.allclose(found, wanted, atol=1e-6)
    pos, neg = draw(2000, True) @ found[:-1] + found[-1], draw(2000, False) @ found[:-1] + found[-1]
    assert (pos > 0).mean() > 0.85 and (neg < 0).mean() > 0.9


def test_toxicity_query_matches_brute_force(spark, tmp_path):
    """A whole query on a small table: words counted, chosen, fitted and scored again by plain Python."""
    import math
    import re

    rng = np.random.default_rng(11)
    bad, plain = ["vile", "awful", "scum"], [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choice(plain, 12).tolist() + (rng.choice(bad, 3).tolist() if toxic else [])
        rows.append((i, " ".join(words), "en", "s", 0, toxic))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(r[0], 1, int(r[5])) for r in rows if r[0] % 2 == 0]
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()}
    learn = [r for r in rows if fold(r[0], 5) != 0]
    known = {i for i, _, t in labels if t and fold(i, 5) != 0}
    counts = {r[0]: {w: r[1].split().count(w) for w in set(re.findall(r"[a-z]+", r[1]))} for r in rows}
    n_p, n_u = len(known), len(learn)
    scored = []
    for w in {w for r in learn for w in counts[r[0]]}:
        p, u = sum(w in counts[i] for i in known), sum(w in counts[r[0]] for r in learn)
        pooled = (p + u + 1) / (n_p + n_u + 2)
        away = (p / n_p - u / n_u) / math.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
        if p + u >= 3 and abs(away) >= toxicity.APART:
            scored.append((-abs(away), w))
    chosen = [w for _, w in sorted(scored)]
    vector = lambda i: [min(math.log2(1 + counts[i].get(w, 0)), 3.0) for w in chosen]
    prior = np.mean([t for i, _, t in labels if fold(i, 5) != 0])
    w = brute_nnpu(np.array([vector(i) for i in known]), np.array([vector(r[0]) for r in learn]), prior)
    for r in rows:
        assert abs(found[r[0]] - 1 / (1 + math.exp(-(np.array(vector(r[0])) @ w[:-1] + w[-1])))) < 1e-5


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_toxicity(spark, extra):
    docs = documents(spark, AWKWARD, extra)
    for labels in ([], [(i, 1, 1) for i in range(1, 10)], [(4, 0, None), (7, 0, 1), (None, 1, 1), (999, 1, 1)]):
        found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score_toxicity(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
