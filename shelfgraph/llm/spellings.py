"""Spelling variants: words one edit apart, the common form of a rare word, and the root of a chain of forms.

A word is a run of letters of at least MIN_LENGTH code points that occurs MIN_COUNT times or more. One error leaves
either half of a word unchanged, so a pair shares its first three or its last three code points. Words are therefore
grouped by these ends, and each group is searched with a bidirectional FM-index (see fmindex.py): one half
exactly, then across the other half with one error. Among words with equal first ends the first half is the exact one, among words with
equal last ends the second half, and there a pair that the first ends find already is left out.

A group larger than INDEX_WORDS is cut by hash into slices, and every slice of queries meets every slice of the index,
so no task holds more than two slices of it whatever its size; smaller groups share a task. A word's near words leave the tasks as one count and one best form.

Defined cases: null and empty texts hold no words. An id that is null is written as nothing before the colon of the hashed text; repeated rows count
again. Words of any length are kept whole. Of equally frequent near words the least in code-point order is the form. Forms have ten times the
count at each step, so chains end and have at most 19 steps. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.durable import written
from shelfgraph.llm.fmindex import BiIndex, one_edit

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10  # a form is at least so many times as frequent as its variant
ENDS = 3  # code points of a shared end: the half of the shortest word
INDEX_WORDS = 1 << 14
QUERY_WORDS = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{MIN_LENGTH},}}"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: every word with its count over all documents."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN})"))).alias("run"))
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = "cast(mark % length(run) as int)"
    word = F.when(F.col("mark") % 31 == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run"))
    found = runs.withColumn("mark", mark).select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def pack(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the bounds of each."""
    strings = words.to_pylist()
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
    bounds = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=bounds[1:])
    return codes, bounds


def part(codes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed words of some rows."""
    size = np.diff(bounds)[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    place = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1][rows], size)
    return codes[place], out


def first_half_equal(codes: np.ndarray, bounds: np.ndarray, query: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether a word starts with the first half of the query: then the other scheme finds the pair."""
    half = np.diff(bounds)[query] // 2
    fits = half <= np.diff(bounds)[word]
    size = np.where(fits, half, 0)
    owner = np.repeat(np.arange(len(query)), size)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    differ = codes[bounds[:-1][query][owner] + k] != codes[bounds[:-1][word][owner] + k]
    return fits & (np.bincount(owner[differ], minlength=len(query)) == 0)


def search_cells(words: pa.Array, n: np.ndarray, cell: np.ndarray, front: np.ndarray, sliced: np.ndarray, indexed: np.ndarray, queried: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, near count, best row) of the rows of some cells; only a cell's own words are compared.

    Whole groups of one side are packed into one index up to INDEX_WORDS words; a cell of a sliced group has an index of
    its own, as a word is in several of its cells.
    """
    codes, bounds = pack(words)
    order = np.lexsort((cell, front))
    edges = np.flatnonzero(np.diff(cell[order], prepend=-1) | np.diff(front[order].astype(np.int8), prepend=-1))
    edges = np.append(edges, len(order))
    start = 0
    while start < len(edges) - 1:
        stop = start + 1
        side, alone = front[order[edges[start]]], sliced[order[edges[start]]]
        while not alone and stop < len(edges) - 1 and edges[stop + 1] - edges[start] <= INDEX_WORDS:
            if front[order[edges[stop]]] != side or sliced[order[edges[stop]]]:
                break
            stop += 1
        rows = order[edges[start] : edges[stop]]
        held, asked = rows[indexed[rows]], rows[queried[rows]]
        start = stop
        if not len(held):
            continue
        index = BiIndex(*part(codes, bounds, held))
        for k in range(0, len(asked), QUERY_WORDS):
            some = asked[k : k + QUERY_WORDS]
            query, word = one_edit(index, *part(codes, bounds, some), prefix_exact=bool(side))
            query, word = some[query], held[word]
            keep = cell[query] == cell[word]
            if not side:
                keep &= ~first_half_equal(codes, bounds, query, word)
            query, word = query[keep], word[keep]
            # best: most frequent, then least in code-point order, which the rows of the caller are in
            best = np.lexsort((word, -n[word], query))
            first = best[np.flatnonzero(np.diff(query[best], prepend=-1))]
            yield query[first], np.bincount(query, minlength=len(n))[query[first]], word[first]


PAIRS = "word string, n_near long, best_n long, best string"


def _search(table: pa.Table) -> pa.Table:
    table = table.sort_by("word")  # Arrow compares bytes, so this is code-point order
    column = lambda name: table.column(name).to_numpy()
    words = table.column("word").combine_chunks()
    n = column("n")
    out = []
    for query, count, best in search_cells(words, n, column("cell"), column("front"), column("sliced"), column("indexed"), column("queried")):
        out.append(pa.table([words.take(pa.array(query)), pa.array(count.astype(np.int64)), pa.array(n[best]), words.take(pa.array(best))], names=["word", "n_near", "best_n", "best"]))
    if not out:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    return pa.concat_tables(out)


def near_words(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """word, n_near, best_n, best: for every word with near words, their number and the most frequent one."""
    sides = F.array(
        F.struct(F.lit(True).alias("front"), F.substring("word", 1, ENDS).alias("ends")),
        F.struct(F.lit(False).alias("front"), F.substring("word", -ENDS, ENDS).alias("ends")),
    )
    rows = words.select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.front", "side.ends")
    sizes = rows.groupBy("front", "ends").agg(F.count("*").alias("size"))
    # the ends are ENDS letters of a fixed alphabet, so this list has a bound whatever the number of words
    hot = sizes.where(F.col("size") > index_words).select("front", "ends", F.ceil(F.col("size") / index_words).cast("int").alias("slices"))
    cut = rows.join(F.broadcast(hot), ["front", "ends"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    # each word stands in the cells (own, j) as indexed and (i, own) as queried
    place = lambda i, j, indexed, queried: F.struct(i.alias("i"), j.alias("j"), F.lit(indexed).alias("indexed"), F.lit(queried).alias("queried"))
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: k != F.col("own"))
    cells = F.concat(
        F.array(place(F.col("own"), F.col("own"), True, True)),
        F.transform(others, lambda k: place(F.col("own"), k, True, False)),
        F.transform(others, lambda k: place(k, F.col("own"), False, True)),
    )
    dealt = cut.withColumn("own", own).select("word", "n", "front", "ends", (F.col("slices") > 1).alias("sliced"), F.explode(cells).alias("c"))
    dealt = dealt.select("word", "n", "front", "ends", "sliced", "c.*")
    cell = F.xxhash64("front", "ends", "i", "j")
    total = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    tasks = max(1, total // (2 * index_words))
    dealt = dealt.select("word", "n", "front", "sliced", "indexed", "queried", cell.alias("cell"), F.pmod(cell, F.lit(tasks)).alias("task"))
    found = dealt.groupBy("task").applyInArrow(_search, PAIRS)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): forms followed to their end by doubling, so rounds are few."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(onward, "root", "left")
        step = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word."""
    words = written(vocabulary(docs), "vocabulary")
    near = near_words(words, index_words)
    known = F.col("best_n") >= RATIO * F.col("n")
    judged = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    chains = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))
