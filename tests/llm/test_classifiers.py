"""Toxicity, quality rules and language: exact parts by brute force, learnt parts by held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfgraph.llm import language, quality, toxicity
from shelfgraph.llm import textbytes as tb

FOLDER = "/root/testdata/sf0.01"
BAD = ["foul", "vile", "nasty"]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, spark.read.parquet(f"{FOLDER}/labels.parquet")


def small_model(spark, documents, prose):
    rows = [(i, prose(i, 30) + (" " + BAD[i % 3] + " " + BAD[(i // 3) % 3] if i % 2 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    return rows, toxicity.fit(documents(rows), labels)


def test_index_search_equals_a_full_scan(spark, documents, prose):
    rows, model = small_model(spark, documents, prose)
    dense = np.zeros((len(model.example), len(model.terms)))
    for t in range(len(model.terms)):
        for lo, hi in zip(model.posting_bounds[t][:-1], model.posting_bounds[t][1:], strict=True):
            dense[model.posting_example[lo:hi], t] = model.posting_weight[lo:hi]
    rng = np.random.default_rng(2)
    for _ in range(40):
        terms = np.sort(rng.choice(len(model.terms), rng.integers(1, len(model.terms) + 1), replace=False))
        weight = rng.random(len(terms))
        weight /= np.linalg.norm(weight)
        near, cosine = toxicity.nearest(model, terms, weight, k=7)
        full = np.round(dense[:, terms] @ weight, 9)
        order = [i for i in np.lexsort((model.example, -full)) if full[i] > 0][:7]
        assert near.tolist() == order and np.allclose(cosine, full[order])


def test_texts_searched_together_find_what_a_full_scan_finds():
    rng = np.random.default_rng(7)
    n, kinds = 40 * toxicity.BLOCK + 5, 300
    held = rng.random((n, kinds)) < np.geomspace(0.6, 0.001, kinds)
    dense = np.where(held, rng.random((n, kinds)), 0.0)
    dense[:, 0] += 1e-3
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    dense[100] = dense[2000]
    term, place = np.nonzero(dense.T)
    edges = np.searchsorted(term, np.arange(kinds + 1))
    blank = toxicity._blank(0.5)
    model = toxicity.Model(blank.terms.copy(), blank.idf, 0.5, 0.5, rng.permutation(n), np.zeros(n, np.int64), np.stack([edges[:-1], edges[1:]], axis=1), place, dense[place, term], blank.knots, blank.levels)
    model.terms = np.arange(kinds, dtype=np.uint64)
    common = toxicity.Common(model)
    assert 0 < common.top.shape[0] < kinds
    asked = np.arange(0, n, 17)[: 2 * toxicity.TOGETHER + 3]
    row, terms = np.nonzero(dense[asked])
    bounds = np.searchsorted(row, np.arange(len(asked) + 1))
    weights = dense[asked][row, terms]
    for skip in (np.full(len(asked), -1), asked):
        found = list(toxicity.nearest_each(model, common, bounds, terms, weights, k=20, skip=skip))
        full = np.round(dense[asked] @ dense.T, 9)
        for i, (near, cosine) in enumerate(found):
            if skip[i] >= 0:
                full[i, skip[i]] = 0
            order = np.lexsort((model.example, -full[i]))[:20]
            assert near.tolist() == order.tolist() and np.allclose(cosine, full[i][order])


def test_toxic_words_decide_and_awkward_rows_pass(spark, documents, prose, awkward):
    rows, model = small_model(spark, documents, prose)
    asked = documents([*awkward, (500, "such a FOUL and vile day"), (501, "sun tree lake")])
    got = {(r["doc_id"], r["score"] >= toxicity.THRESHOLD) for r in toxicity.score(asked, model).collect()}
    assert {d for d, bad in got if bad} == {500}
    kept = toxicity.keep_clean(asked, model)
    assert kept.columns == asked.columns and kept.count() == asked.count() - 1


def test_copies_of_examples_find_them_whatever_their_words(spark, documents, prose):
    rows, model = small_model(spark, documents, prose)
    asked = documents([(1000 + i, prose(i, 30)) for i in range(0, 120, 2)] + [(1001, f"{rows[1][1]}")])
    found = {r["doc_id"]: r["evidence"] for r in toxicity.score(asked, model).collect()}
    assert {d: e[0] for d, e in found.items()} == {**{1000 + i: i for i in range(0, 120, 2)}, 1001: 1}


def test_far_neighbours_do_not_outvote_a_near_one_and_levels_rise(spark, documents, prose):
    _, model = small_model(spark, documents, prose)
    good, bad = np.flatnonzero(model.toxic == 0), np.flatnonzero(model.toxic == 1)
    near = np.append(good[:1], bad[:14])
    assert toxicity.vote(model, near, np.append(0.8, np.full(14, 0.05))) < model.share
    assert toxicity.vote(model, bad[:5], np.full(5, 0.002)) < 0.6 < toxicity.vote(model, bad[:5], np.full(5, 0.5))
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.knots) > 0).all()


def test_no_labels_predict_nothing(spark, documents, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(awkward)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(documents([]), toxicity.fit(documents([]), none)).count() == 0


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    fold = tb.crc32_of_id() % 3
    model = toxicity.fit(docs, labels, may_learn=fold != 1)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    pairs = [(truth[r["doc_id"]], r["score"] >= toxicity.THRESHOLD) for r in toxicity.score(docs, model).collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    clean = [p for t, p in pairs if t == 0]
    toxic = [p for t, p in pairs if t == 1]
    assert np.mean(clean) < 0.05 and np.mean(toxic) > 0.5


def test_a_few_marked_words_decide_between_long_texts_of_equal_words(spark, documents, prose):
    """Held-out toxic texts are found by one or two marked words among 80 that clean texts use as well."""
    bank = prose(1, 400).split()
    marked = [f"{BAD[i % 3]}{end}" for i, end in enumerate(("o", "an", "es", "ent", "ou", "le"))]
    rows = [(i, prose(100 + i, 80, bank) + (" " + prose(9000 + i, 2, marked) if i % 4 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, toxicity.fit(docs, labels)).collect()}
    held = range(400, 600)
    assert np.mean([i not in kept for i in held if i % 4 == 0]) > 0.9
    assert np.mean([i in kept for i in held if i % 4]) > 0.97


def test_marking_raises_what_chance_does_not_explain_and_counts_copies_once():
    # word 0 in all, 1 in the toxic, 2 in half of either, 3 in three of the toxic; one word of its own in each
    held = [{0, 10 + i} | ({1} if i < 40 else set()) | ({2} if i % 2 else set()) | ({3} if i < 3 else set()) for i in range(80)]
    keys, y = [np.array(sorted(h), np.uint64) for h in held], np.repeat([1, 0], 40)
    terms = np.unique(np.concatenate(keys))
    weight = toxicity.marking(keys, y, terms)
    assert weight[1] == pytest.approx((1 + np.sqrt(160 * np.log(2)) - toxicity.CHANCE) ** 2)
    assert (np.delete(weight, 1) == 1).all()
    again = toxicity.marking(keys + [keys[0]] * 300, np.append(y, np.ones(300, int)), terms)
    assert np.allclose(again, weight)


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_brute_force(spark, documents, prose, awkward):
    rows = [*awkward, (20, "a b c d e f a b c d e g " * 3), (21, "x\nx\n \nx\ny"), (22, "#*$ <a> é"), (23, prose(1, 40)), (24, "q\x0bq\x0cq\rq q q q q q q q q")]
    docs = documents(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs, quality.fit(docs, none)).collect())
    assert got == Counter((d, *plain_counts(t)) for d, t in rows)


def test_quality_model_separates_labels(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.judge(docs, model).collect() if r["doc_id"] in truth and not r["base_failed"]]
    good = [r["kept"] for r in rows if truth[r["doc_id"]] == 1]
    poor = [r["kept"] for r in rows if truth[r["doc_id"]] == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.5


def test_language_on_held_out_rows(labelled, spark, documents, awkward):
    docs, _ = labelled
    held = tb.crc32_of_id() % 5 == 0
    model = language.fit(docs.where(~held))
    truth = {r["doc_id"]: r["lang"] for r in docs.where(held).collect()}
    rows = [r for r in language.predict(docs, model).collect() if r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95
    odd = language.predict(documents([*awkward, (30, "12 34 ?!")]), model).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 30)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in odd)


def test_mixture_recovers_proportions(labelled):
    docs, _ = labelled
    model = language.fit(docs)
    rows = {r["lang"]: r["text"] for r in docs.where("length(text) > 2500").dropDuplicates(["lang"]).collect()}
    text = " ".join(rows["en"].split()[:300] + rows["de"].split()[:100])
    share, known = language.identify(model, pa.array([text]))
    found = dict(zip(model.languages, share[0], strict=True))
    assert known[0] and abs(found["en"] - 0.75) < 0.1 and abs(found["de"] - 0.25) < 0.1


def test_nothing_learnt_is_undetermined(spark, documents, awkward):
    docs = documents(awkward)
    model = language.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}


def test_toxicity_index_is_built_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    vocabulary = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64))
    rows = []
    for i in range(600):
        at = np.unique(rng.integers(0, len(vocabulary), 500))
        rows.append({"doc_id": i, "toxic": i % 2, "terms": vocabulary[at].tobytes(), "counts": np.ones(len(at), np.int32).tobytes()})
    keys = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    terms = np.unique(np.concatenate(keys))
    tracemalloc.start()
    model = toxicity._index(rows, keys, np.arange(600) % 2, np.ones(2), terms, np.ones(len(terms)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.posting_weight) == sum(len(k) for k in keys) and peak < 100 * len(model.posting_weight)
