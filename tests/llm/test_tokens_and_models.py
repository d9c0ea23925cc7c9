"""Token files, packing, decontamination, secrets, language-model scores and the pipeline."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfgraph.llm import attention, decontaminate, forest, lmscore, packing, secrets, tokenfiles
from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.durable import shared_path
from shelfgraph.llm.subwords import Encoder


def ids_of(text, end):
    found = Encoder().tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*found, end], "<u4")


def test_token_files_round_trip(spark, documents, prose, awkward):
    rows = [*awkward, *((100 + i, prose(i, 20 + i)) for i in range(40))]
    path = shared_path(spark, "test-tokens")
    tokenfiles.write(documents(rows).repartition(3), path, shard_rows=16)
    got = tokenfiles.read(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((d, ids_of(t, tokenfiles.END).tobytes()) for d, t in rows)
    assert [x.tolist() for x in tokenfiles.fetch(spark, path, 100)] == [ids_of(rows[-40][1], tokenfiles.END).tolist()]
    assert len(tokenfiles.fetch(spark, path, 5)) == 2 and tokenfiles.fetch(spark, path, 999) == []


def test_token_files_of_an_empty_table(spark, documents):
    assert tokenfiles.round_trip(documents([])).count() == 0


def test_packing_covers_every_id_once(spark, documents, prose, awkward):
    rows = [r for r in awkward if r[0] not in (5, None)] + [(100 + i, prose(i, 5 + 13 * i)) for i in range(60)]
    got = packing.pack(documents(rows).repartition(2)).collect()
    texts, windows = defaultdict(list), defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for doc, text in rows:
        whole, at = ids_of(text, packing.END), 0
        for r in sorted(texts[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert bytes(r["ids"]) == whole[at : at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(whole)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert packing.pack(documents([])).count() == 0


def test_differencing_evens_out_and_count_rises_past_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 500).tolist()
    parts = packing.differencing(sizes, 40)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(500)) and max(sums) - min(sums) <= 8
    assert len(packing.fill([1500, 1500, 1000])) == 3


def edit_distance_to_substring(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        fresh = [0]
        for i, p in enumerate(pattern):
            fresh.append(min(row[i] + (p != c), row[i + 1] + 1, fresh[-1] + 1))
        row = fresh
        best = min(best, row[-1])
    return best


def folded(text):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())).encode()


def test_leaks_equal_brute_force(spark, documents, prose, awkward):
    items = [(i, prose(300 + i, 12 + 4 * i)) for i in range(8)] + [(8, "short"), (9, None), (10, prose(300, 12))]
    rows = list(awkward)
    for i, text in items[:8]:
        for k in range(6):
            w = list(text)
            for e in range(2 * k):
                at = (e * 31 + 7 * k) % len(w)
                w[at] = "z" if e % 2 else ""
            rows.append((1000 + 10 * i + k, prose(i + k, 10) + " -- " + "".join(w).upper() + "!\n" + prose(i, 5)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(documents(rows), benchmark).collect()}
    want = {}
    for doc, text in rows:
        for item, pattern in items:
            p = folded(pattern)
            if len(p) >= decontaminate.MIN_ITEM and len(text or "") < 3000:
                budget = min(int(len(p) * decontaminate.BUDGET), len(p) // decontaminate.SEED - 1)
                d = edit_distance_to_substring(p, folded(text))
                if d <= budget:
                    want[doc, item] = d
    assert got == want and len(want) > 20
    clean = decontaminate.keep_clean(documents(rows), benchmark)
    assert clean.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.leaks(documents([]), benchmark).count() == 0
    assert decontaminate.leaks(documents(rows), benchmark.limit(0)).count() == 0


def secret_rows(prose, seed=0):
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(80)]
    rows = [(i, prose(seed + i, 30) + f' token = "{h}" ' + prose(seed + i + 500, 20)) for i, h in enumerate(hexes[:40])]
    return rows + [(100 + i, prose(i, 30) + f" {int(h[:8], 16):010d}{int(h[8:14], 16):08d} " + prose(i, 20)) for i, h in enumerate(hexes[40:])]


def test_secrets_are_found_and_redacted(spark, documents, prose, awkward):
    docs = documents([*secret_rows(prose), *awkward])
    model, found = secrets.learn(docs)
    hits = secrets.scan(found, model)
    assert {r["doc_id"] for r in hits.where("is_secret").collect()} == set(range(40))
    out = {r["doc_id"]: r for r in secrets.redact(docs, model).where("doc_id < 40 and doc_id > 12").collect()}
    assert all(re.search(r'token = "\[SECRET\]"', r["text"]) and r["n_chars"] == len(r["text"]) for r in out.values())
    assert secrets.redact(docs, model).count() == docs.count()


def test_secrets_without_findings(spark, documents):
    model, found = secrets.learn(documents([]))
    assert model.trees == [] and secrets.scan(found, model).count() == 0


def test_forest_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((800, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    trees = forest.fit(x[:500], y[:500])
    assert ((forest.predict(trees, x[500:]) > 0.5) == y[500:]).mean() > 0.9


def test_unigram_scores_equal_brute_force(spark, documents, prose, awkward):
    rows = [*awkward, *((100 + i, prose(i % 7, 30) + " Mixed CASE é") for i in range(20))]
    held = F.coalesce(tb.crc32_of_id() % 7 == 2, F.lit(False))
    got = lmscore.score(documents(rows).withColumn("held_out", held)).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    counts = Counter()
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for (d, _), w in zip(rows, words, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_context_is_learnt_from_texts_outside_the_sample(spark, documents):
    rng = np.random.default_rng(3)
    bank = ["red", "blue", "green", "dog", "cat", "house", "tree", "river"]
    mixed = lambda n: " ".join(rng.choice(bank, n))
    # rows without an id are learnable, but never in the sample
    rows = [(1, mixed(100)), (2, " ".join(bank * 12)), (3, mixed(96)), *((None, " ".join(bank * 25)) for _ in range(80))]
    got = {r["doc_id"]: r["score"] for r in lmscore.score(documents(rows).withColumn("held_out", F.coalesce(F.col("doc_id") > 1, F.lit(False)))).collect()}
    assert got[2] > -45


def test_windows_score_each_id_once_and_only_from_earlier_ids():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 90, 400)
    model = attention.fit(counts, [rng.integers(0, 399, 70) for _ in range(4)], steps=3)
    ids, bounds = rng.integers(0, 399, 150), np.array([0, 0, 75, 150])
    inputs, target, full, _ = attention.windows(ids, bounds, model.kind)
    assert sorted(target[target >= 0].tolist()) == list(range(len(full)))
    a = attention.forward(model.weights, inputs)[0]
    assert np.allclose(a, attention._logits(model.weights, attention._tables(model.weights), inputs), atol=1e-4)
    whole = attention.log10_probabilities(model, ids, bounds)
    apart = [attention.log10_probabilities(model, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.allclose(whole, apart, atol=1e-4)
    # over all ids the next one's probabilities add up to one
    head = ids[:20]
    before = attention.log10_probabilities(model, head, np.array([0, 20]))[0]
    tails = [attention.log10_probabilities(model, np.append(head, x), np.array([0, 21]))[0] for x in range(0, 399, 37)]
    assert all(t < before + 3 for t in tails)
    kinds = np.exp(model.inner)
    assert np.allclose(np.bincount(model.kind, kinds, minlength=attention.CLASSES)[np.unique(model.kind)], 1)


def test_gradient_in_parts_is_the_slope_of_the_loss():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, 200)
    counts[-1] = 9
    kind, _ = attention.classify(counts.astype(float))
    weights = {k: v * 2 for k, v in attention.fresh_weights(np.bincount(kind, counts, minlength=attention.CLASSES)).items()}
    sizes = rng.integers(0, 90, 60)
    inputs, target, full, _ = attention.windows(rng.integers(0, 199, sizes.sum()), np.append(0, np.cumsum(sizes)), kind)
    assert len(inputs) > attention.PART
    kinds, valid = kind[full[np.maximum(target, 0)]].reshape(-1), (target >= 0).astype(np.float32).reshape(-1)

    def loss(w):
        logits = attention.forward(w, inputs)[0].astype(float)
        picked = np.take_along_axis(logits, kinds[:, None], axis=1)[:, 0]
        return ((np.log(np.exp(logits).sum(axis=1)) - picked) * valid).sum() / valid.sum()

    found, slopes = attention.gradient(weights, inputs, kinds, valid)
    assert found == pytest.approx(loss(weights), rel=1e-5) and slopes.keys() == weights.keys()
    for name, slope in slopes.items():
        way = rng.standard_normal(slope.shape)
        up, down = ({**{k: v.astype(float) for k, v in weights.items()}, name: weights[name] + sign * 1e-6 * way} for sign in (1, -1))
        assert (loss(up) - loss(down)) / 2e-6 == pytest.approx((slope * way).sum(), rel=1e-3, abs=1e-5), name


def test_followers_equal_brute_force():
    rng = np.random.default_rng(6)
    sizes = np.array([0, 3, 1, 30, 0, 80])
    bounds = np.append(0, np.cumsum(sizes))
    ids, kind = rng.integers(0, 99, sizes.sum()), rng.permutation(100) % 7
    want = np.zeros(attention.FOLLOWERS, int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        line = [attention.CLASSES, *kind[ids[a:b]], kind[-1]]
        for k in range(1, len(line)):
            for away in range(min(k, attention.FAR)):
                want[min(away, attention.GROUPS - 1), line[k - 1 - away], line[k]] += 1
    assert (attention.followers(ids, bounds, kind) == want).all()


def test_an_id_is_told_by_the_one_before_among_hundreds():
    """Each of 300 ids has one successor, which its class must not hide."""
    ids, bounds = np.tile(np.arange(300), 50), np.array([0, 15000])
    counts = np.append(np.bincount(ids, minlength=300), 1)
    model = attention.fit(counts, [ids], steps=100)
    assert attention.log10_probabilities(model, ids, bounds)[0] > -0.5 * len(ids)


def test_strong_attention_gives_finite_scores():
    rng = np.random.default_rng(9)
    counts = rng.integers(1, 90, 400)
    ids, bounds = rng.integers(0, 399, 900), np.array([0, 400, 400, 900])
    model = attention.fit(counts, [ids], steps=2)
    for name in ("query", "key"):
        model.weights[name] *= 60
    scores = attention.log10_probabilities(model, ids, bounds)
    assert np.isfinite(scores).all() and (scores < 0).all()


def test_learning_computes_no_distribution_whole():
    """A step over all targets costs less than their whole distributions, which only the plain form computes."""
    rng = np.random.default_rng(7)
    counts = rng.integers(1, 90, 400)
    kind, _ = attention.classify(counts.astype(float))
    w = attention.fresh_weights(np.bincount(kind, counts, minlength=attention.CLASSES))
    inputs, target, full, _ = attention.windows(rng.integers(0, 399, 16000), np.array([0, 16000]), kind)
    kinds, valid = kind[full[np.maximum(target, 0)]].reshape(-1), (target >= 0).astype(np.float32).reshape(-1)

    def least(run):
        took = []
        for _ in range(5):
            began = time.thread_time()
            run()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: attention.gradient(w, inputs, kinds, valid)) < least(lambda: attention.forward(w, inputs))


def test_windows_hold_the_marks_and_ids_before_each_target():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 1, 15, 16, 17, 40, 0, 70])
    bounds = np.append(0, np.cumsum(sizes))
    ids, kind = rng.integers(0, 99, sizes.sum()), rng.permutation(100) % attention.CLASSES
    inputs, target, full, text = attention.windows(ids, bounds, kind)
    scored = []
    for row, goals, of in zip(inputs, target, text, strict=True):
        own = [attention.CLASSES + 1] * attention.WINDOW + [attention.CLASSES] + kind[ids[bounds[of] : bounds[of + 1]]].tolist()
        for k, goal in enumerate(goals):
            if goal >= 0:
                scored.append(goal)
                last = attention.WINDOW - attention.BLOCK + k + 1
                upto = attention.WINDOW + 1 + goal - bounds[of] - of
                assert row[:last].tolist() == own[upto - last : upto]
    assert scored == list(range(len(full)))


@pytest.mark.parametrize("rest", [0.1, 0.4, 0.9])
def test_batches_fall_into_even_flushes(rest):
    """No small rest, that would be learnt from several times over to take as many steps as other flushes."""
    text = pa.array(["x" * 3000] * int((3 + rest) * lmscore.FLUSH_BYTES / 3000))
    parts = list(tb.slices(text, lmscore._even(3000 * len(text))))
    sizes = [3000 * (b - a) for a, b in parts]
    assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(text)
    assert max(sizes) <= lmscore.FLUSH_BYTES and min(sizes) > 0.9 * max(sizes)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(5)
    pattern = np.tile(np.arange(20), 60)
    counts = np.bincount(pattern, minlength=101)
    counts[100] = 1
    long = attention.fit(counts, [pattern], steps=150)
    short = attention.fit(counts, [pattern], steps=1)
    bounds = np.array([0, len(pattern)])
    assert attention.log10_probabilities(long, pattern, bounds)[0] > attention.log10_probabilities(short, pattern, bounds)[0] * 0.5
    assert rng is not None


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "decontamination", "secrets", "packing"])
def test_stage_order(name):
    import corpus_pipeline

    assert name in [s for s, _ in corpus_pipeline.STAGES] and [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


def test_pipeline_decisions_take_effect(spark, tmp_path, documents, prose):
    import corpus_pipeline

    bank = ["sun", "tree", "lake", "hill", "rain", "stone", "river", "cloud"]
    item = prose(999, 20)
    rows = [(i, prose(i, 40) + (" foul vile nasty foul" if i % 2 else "")) for i in range(80)]
    rows += [(200, prose(5000, 60)), (201, prose(5000, 60)), (202, "start " + prose(5001, 20) + " " + item + " end"), (203, None), (204, "")]
    rows += [(300 + i, r[1] + " " + prose(7000 + i, 3, bank)) for i, r in enumerate(secret_rows(prose, 20000)[:20])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not got & {i for i in range(80) if i % 2} and 202 not in got and 201 not in got
    assert {i for i in range(0, 80, 2)} | {200, 203} | set(range(300, 320)) <= got


def test_pipeline_stages_bound_the_bytes_of_batches(spark, tmp_path):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(300, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 5000) AS text")
    spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of a benchmark that no text holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    before = spark.conf.get(name)
    try:
        for stage, run in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            run(spark, docs.where("doc_id < 2"), str(tmp_path))
            got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in got) == 300 and max(r["bytes"] for r in got) < 2 * tb.BATCH_BYTES, stage
    finally:
        spark.conf.set(name, before)
