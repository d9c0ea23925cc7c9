"""Ranked search, license scans and spelling variants against brute force in plain Python."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from compare import connect, differences
from shelfgraph.llm import lexical, licenses, queries, spellings
from shelfgraph.llm.fmindex import BiIndex, one_edit

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_licenses", "op13_spellings"])
def test_query_equals_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE_SQL[name]) == []


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def brute_search(docs, items, k):
    held = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) * r for t, r in Counter(TERM.findall(lowered(text))).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def searched(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_takes_awkward_rows(spark, documents, awkward):
    items = [(1, "one word"), (2, None), (3, ""), (None, "line x"), (1, "one WORD"), (4, "absent"), (5, "é 中文 no ID"), (6, "word word one")]
    got = lexical.search(documents(awkward), spark.createDataFrame(items, ITEMS))
    assert searched(got) == brute_search(awkward, items, 20)


@pytest.mark.parametrize("seed,shard", [(1, 4096), (2, 3), (3, 1)])
def test_search_with_ties_hot_strata_and_small_shards(spark, documents, monkeypatch, seed, shard):
    rng = random.Random(seed)
    bank = [f"t{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(bank, k=rng.choice([5, 5, 5, 1, 9, 200])))) for i in range(300)] + [(7, "t1 t2")] * 40
    items = [(q, " ".join(rng.choices(bank, k=rng.randint(1, 12)))) for q in range(12)]
    monkeypatch.setattr(lexical, "SHARD", shard)
    got = lexical.search(documents(rows).repartition(5), spark.createDataFrame(items, ITEMS), k=7)
    assert searched(got) == brute_search(rows, items, 7)


def test_search_in_blocks_of_items_gives_the_same(spark, documents, prose, monkeypatch):
    rows = [(i, prose(i % 9, 30)) for i in range(60)]
    items = [(q, prose(q, 6)) for q in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    assert searched(lexical.search(documents(rows), spark.createDataFrame(items, ITEMS))) == brute_search(rows, items, 20)


def test_search_of_empty_tables_and_clashing_columns(spark, documents):
    none, items = documents([]), spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical.search(none, items).collect() == []
    assert lexical.search(documents([(1, "a")]), spark.createDataFrame([], ITEMS)).collect() == []
    clash = documents([(1, "a b"), (2, "c")]).selectExpr("doc_id", "text", "1 as m", "2 as n", "3 as item_id", "4 as score", "5 as rank")
    assert searched(lexical.search(clash, items)) == brute_search([(1, "a b"), (2, "c")], [(1, "a b")], 20)


def test_a_bar_above_the_bound_leaves_strata_out(documents):
    block = lexical.prepare([(1, "needle hay")])
    weight = np.array([5, 5])
    rows = lexical.postings(documents([(i, "hay " * 5) for i in range(9)] + [(9, "needle hay")]), block)
    batch = rows.selectExpr("75L as m", "doc_id", "term", "tf").toArrow().combine_chunks().to_batches()[0]
    (stratum,) = lexical.strata(batch)
    bound = lexical.bounds_of(stratum, block, weight)
    best = lexical.Leaders(2, np.array([int(bound[0]) + 1]))
    lexical.visit(stratum, np.array([0]), block, weight, batch.column(1).to_numpy(), np.zeros(10, bool), best)
    assert not best.held
    best = lexical.Leaders(2, np.zeros(1, np.int64))
    lexical.visit(stratum, np.array([0]), block, weight, batch.column(1).to_numpy(), np.zeros(10, bool), best)
    assert best.held[0][0][1] == 9 and best.bar[0] == best.held[0][1][0] <= bound[0]


# license scans


def brute_licenses(rows, templates=licenses.TEMPLATES, containment=licenses.CONTAINMENT):
    cut = [(label, licenses.split_words(text)) for label, text in templates if label is not None and text]
    out = []
    for doc_id, text in rows:
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        places, base, more, best = [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            parts = phrase.split()
            here = [i for i in range(len(ws)) if ws[i : i + len(parts)] == parts]
            places += here
            base |= {label} if here else set()
        for step in {1 << (len(t) - 1).bit_length() for _, t in cut if t}:
            for a in range(0, len(ws), step):
                held = set(ws[a : a + 2 * step])
                fits = [(len(set(t) & held) / len(set(t)), label) for label, t in cut if t and 1 << (len(t) - 1).bit_length() == step]
                fits = [f for f in fits if f[0] >= containment - 1e-9]
                if fits:
                    top = max(fits)[0]
                    more |= {label for c, label in fits if c == top}
                    best = max(best, top)
        score = 1.0 if places else best
        out.append((doc_id, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)))
    return sorted(out, key=repr)


def licensed(found):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted(((*tuple(r)[:7], round(r["score"], 9)) for r in found.select(names).collect()), key=repr)


def notices(prose):
    rng = random.Random(4)
    rows = [(1, "cc by cc by, CC-BY MIT\nLicense submit license"), (2, "GNU General Public\tLicense; apache license"), (3, "mit licence mıt license")]
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        ws = text.split()
        for cut in (0, len(ws) // 10, len(ws) // 3):
            kept = [w for i, w in enumerate(ws) if i not in set(rng.sample(range(len(ws)), cut))]
            rows.append((10 * k + cut, prose(k, rng.randint(0, 90)) + " " + " ".join(kept) + "\n" + prose(k + 50, rng.randint(0, 90))))
        rng.shuffle(ws)
        rows.append((1000 + k, prose(k, 40) + " " + " ".join(ws)))
    return rows


def test_licenses_equal_brute_force(documents, awkward, prose):
    rows = awkward + notices(prose)
    assert licensed(licenses.labels(documents(rows).repartition(3))) == brute_licenses(rows)


@pytest.mark.parametrize("containment", [0.3, 0.55, 1.0])
def test_any_containment_finds_every_block(documents, containment):
    rng = random.Random(int(containment * 100))
    bank = [f"w{k}" for k in range(12)]
    templates = [(f"l{k}", " ".join(rng.choices(bank, k=rng.randint(1, 9)))) for k in range(8)] + [(None, "w1"), ("void", "!!"), ("none", None), ("l1", "w3 w3 w3")]
    rows = [(i, " ".join(rng.choices(bank + ["x", "y", "z"], k=rng.randint(0, 60)))) for i in range(60)]
    assert licensed(licenses.labels(documents(rows), templates, containment)) == brute_licenses(rows, templates, containment)


def test_license_spans_and_empty_tables(spark, documents):
    text = "x " * 40 + "Released under the MIT License" + " y" * 40
    spans = licenses.scan(documents([(1, text)])).spans().where("label = 'mit'").collect()
    assert spans and all(r["first_word"] <= 40 < r["end_word"] for r in spans)
    assert licenses.labels(documents([])).collect() == []
    assert licensed(licenses.labels(documents([(1, "mit license")]), [])) == brute_licenses([(1, "mit license")], [])
    clash = documents([(1, "mit license")]).selectExpr("doc_id", "text", "1 as row", "2 as label", "3 as step", "4 as tokens", "5 as score")
    assert licensed(licenses.labels(clash)) == brute_licenses([(1, "mit license")])


def test_license_plan_is_native(documents):
    plan = licenses.labels(documents([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# spelling variants


def close(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def packed(ws):
    return np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum([len(w) for w in ws], dtype=np.int64)])


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_all_words_one_edit_away(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcé"
    held = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(120)})
    asked = held if seed % 3 else sorted({"".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 8))) for _ in range(60)})
    index = BiIndex(*packed(held))
    for front in (True, False):
        query, word = one_edit(index, *packed(asked), prefix_exact=front)
        got = [(asked[q], held[w]) for q, w in zip(query, word)]
        fits = lambda a, b: b.startswith(a[: len(a) // 2]) if front else b.endswith(a[len(a) // 2 :])  # noqa: B023, E731
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in asked for b in held if close(a, b) and fits(a, b)}


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    count = {w: n for w, n in count.items() if n >= 2}
    form, near = {}, {}
    for w in count:
        near[w] = [v for v in count if close(w, v)]
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        if best and count[best] >= 10 * count[w]:
            form[w] = best
    out = []
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.append((w, count[w], len(near[w]), form.get(w), count.get(form.get(w)), root))
    return sorted(out, key=repr)


def varied(found):
    return sorted((tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


def misspelt(seed):
    rng = random.Random(seed)
    bank = ["".join(rng.choice(["ca", "re", "no", "ti", "l", "é"]) for _ in range(rng.randint(4, 6))) for _ in range(12)]
    rows = []
    for i in range(300):
        ws = []
        for _ in range(40):
            w = bank[min(int(rng.expovariate(0.4)), len(bank) - 1)]
            while rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aelt") + w[k:], w[:k] + rng.choice("aelt") + w[k + 1 :]])
            ws.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((rng.choice([i, i, None]), " ".join(ws)))
    return rows


@pytest.mark.parametrize("seed,index_words", [(1, 1 << 14), (2, 40), (3, 5)])
def test_variants_equal_brute_force_in_whole_and_sliced_groups(documents, seed, index_words):
    rows = misspelt(seed)
    want = brute_variants(rows)
    assert varied(spellings.variants(documents(rows), index_words)) == want
    assert any(r[3] for r in want) and any(r[5] != (r[3] or r[0]) for r in want)


def test_variants_of_awkward_rows(documents, awkward):
    rows = awkward + [(20, "abcdefgh " * 40 + "abcdefg " * 2 + "abcdefghi " * 3), (21, "ab" * 3000 + " " + "ab" * 3000 + "a"), (22, "ab" * 3000 + " " + "ab" * 3000 + "a")]
    assert varied(spellings.variants(documents(rows))) == brute_variants(rows)
    assert spellings.variants(documents([])).collect() == [] and spellings.variants(documents([(1, None)])).collect() == []
    clash = documents([(1, "abcdefgh abcdefgh")]).selectExpr("doc_id", "text", "1 as word", "2 as n", "3 as form", "4 as cell")
    assert varied(spellings.variants(clash)) == brute_variants([(1, "abcdefgh abcdefgh")])


def test_long_chains_of_forms_reach_their_root(spark):
    names = [f"w{k:02d}" for k in range(19)]
    forms = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])], "word string, form string")
    assert {tuple(r) for r in spellings.roots(forms).collect()} == {(w, names[-1]) for w in names[:-1]}
