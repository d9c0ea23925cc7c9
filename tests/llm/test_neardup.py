import re
from collections import Counter

import numpy as np
import pytest

from shelfgraph.llm import bagminhash, neardup


def multiset(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    sets = [multiset(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if sets[i] == sets[j] or (either and both >= neardup.SIMILARITY * either):
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def edited(prose, text, seed, edits):
    w = text.split()
    for k in range(edits):
        w[(seed * 37 + k * 53) % len(w)] = prose(seed * 100 + k, 1) + str(seed)
    return " ".join(w)


def test_classes_equal_brute_force(spark, documents, prose, awkward):
    rows = [r for r in awkward if r[0] != 7]
    for g in range(4):
        base = prose(g, 120 + 40 * g)
        rows += [(100 * (g + 1) + i, base if i % 4 == 0 else edited(prose, base, g * 50 + i, 1 + i % 4)) for i in range(14)]
    rows += [(900 + i, prose(70 + i, 50)) for i in range(20)]
    rows += [(950, "again and again " * 60), (951, "again and again " * 58), (952, "again and again " * 30)]
    got = neardup.classes(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def crossed(prose, pairs):
    """Pairs of texts that are linked to one another only, all edited from one absent text, so that every bucket is crowded."""
    rng = np.random.default_rng(4)
    base, rows = prose(77, 400).split(), []
    for g in range(pairs):
        places = rng.permutation(66) * 6
        for i in range(2):
            w = list(base)
            for k in [*places[:3], *places[3 + 4 * i : 7 + 4 * i]]:
                w[k] = f"{g}x{k}" + (f"y{i}" if k not in places[:3] else "")
            rows.append((2 * g + i, " ".join(w)))
    return rows


def test_links_between_members_of_crowded_buckets_are_all_found(spark, documents, prose):
    rows = crossed(prose, 60)
    rows += [(1000 + i, " ".join(prose(5, 300).split()[: 150 + i])) for i in range(0, 150, 3)]  # a chain without a common original
    got = neardup.classes(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_document_of_each_class_stays_with_all_columns(spark, documents, prose):
    rows = [(3, prose(1, 50)), (2, prose(1, 50)), (9, prose(2, 50)), (9, prose(2, 50)), (4, None)]
    docs = documents(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 9]


@pytest.mark.parametrize("most,moved", [(neardup.BROADCAST_IDS, False), (0, True)])
def test_texts_are_not_shuffled_to_drop_a_bounded_list(spark, documents, prose, monkeypatch, capsys, most, moved):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", most)
    rows = [(i, prose(i // 2, 50)) for i in range(20)] + [(None, prose(50, 50))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_one(documents(rows).where("doc_id >= 0"))
        kept.explain()
        assert ("SortMergeJoin" in capsys.readouterr().out) == moved
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 20, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_an_id_are_linked_to_near_texts(documents, prose):
    text = prose(3, 200)
    near = lambda k: " ".join([*text.split()[:-1], f"other{k}"])
    lone = prose(8, 80)
    rows = [(None, text), (1, near(1)), (None, near(2)), (None, lone), (None, lone + " end"), (7, prose(9, 60))]
    assert sorted(map(tuple, neardup.classes(documents(rows)).collect()), key=str) == brute(rows)
    kept = sorted((r["doc_id"], len(r["text"].split())) for r in neardup.keep_one(documents(rows)).where("doc_id is not null").collect())
    assert kept == [(1, 200), (7, 60)]
    assert neardup.keep_one(documents(rows)).where("doc_id is null").count() == 1


def test_rows_with_one_id_are_kept_by_their_own_text(documents, prose):
    rows = [(3, prose(1, 60)), (5, prose(2, 60)), (5, prose(1, 60)), (5, prose(2, 60)), (6, prose(4, 60)), (6, prose(5, 60))]
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(documents(rows)).collect())
    assert kept[:2] == [(3, prose(1, 60)), (5, prose(2, 60))] and [k[0] for k in kept[2:]] == [6]


@pytest.mark.parametrize("block,strip", [(512, 8192), (7, 16)])
def test_a_crowded_group_mostly_below_the_threshold(documents, prose, monkeypatch, block, strip):
    """All pairs are alike, few are linked, some only through others; cells of any size find the same classes."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STRIP", strip)
    rows = crossed(prose, 40) + [(500 + i, prose(5, 300) + " x" * (i % 3)) for i in range(9)] + [(600, "a b " * 90), (601, "a b " * 80)]
    assert sorted(map(tuple, neardup.classes(documents(rows)).collect()), key=str) == brute(rows)


def test_block_overlaps_equal_pairwise_similarity():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 60, 40).astype(np.uint32))
        sets.append((keys, rng.integers(1, 4, len(keys)).astype(np.uint32) if rng.random() < 0.5 else np.ones(len(keys), np.uint32)))
    blobs = [k.tobytes() for k, _ in sets], [b"" if (c == 1).all() else c.tobytes() for _, c in sets]
    got = neardup.overlaps(tuple(x[:15] for x in blobs), tuple(x[15:] for x in blobs))
    for i in range(15):
        for j in range(25):
            exact = bagminhash.similarity(sets[i][0], sets[i][1].astype(np.int64), sets[15 + j][0], sets[15 + j][1].astype(np.int64))
            assert got[i, j] == (exact >= neardup.SIMILARITY - 1e-12)


def test_empty_table(spark, documents):
    assert neardup.classes(documents([])).count() == 0


@pytest.mark.parametrize("heavy", [1, 40, 3000])
def test_signature_agreement_is_the_weighted_jaccard_similarity(heavy):
    rng = np.random.default_rng(heavy)
    element = rng.integers(1, 2**63, 50).astype(np.uint64)
    a, b = rng.integers(0, 5, 50), rng.integers(0, 5, 50)
    b[:30] = a[:30]
    a[0], b[0] = heavy, max(1, heavy * 2 // 3)
    keep_a, keep_b = np.flatnonzero(a), np.flatnonzero(b)
    s = bagminhash.signatures(np.append(element[keep_a], element[keep_b]), np.append(a[keep_a], b[keep_b]), np.array([0, len(keep_a), len(keep_a) + len(keep_b)]), 20000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 20000)
