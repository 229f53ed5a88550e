"""Exact dedup, Jaccard join, components and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.edge import TEXTS, words
from pyspark.sql import functions as F

from conftest import SF
from tremor.llm import jaccard
from tremor.llm.components import components
from tremor.llm.decontaminate import contamination, index, items, near
from tremor.llm.exact_dedup import Directory, _owned_rows, bucketed, directory, exact_groups, owned
from tremor.llm.jaccard import apart, jaccard_components, prefix_length, similar
from tremor.llm.shingles import shingle_sets

ROW_KEY = lambda r: tuple(str(x) for x in r)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=ROW_KEY)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_on_edges(edges, bits):
    got = [tuple(r) for r in exact_groups(edges, capacity=4, max_depth=6, bits=bits, part_rows=2).collect()]
    assert sorted(got, key=ROW_KEY) == brute_exact(TEXTS)


def test_exact_groups_on_documents(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in exact_groups(docs).collect()), key=ROW_KEY)
    assert got == brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_groups(none).collect() == []


def test_directory_doubles_and_covers_all_keys():
    counts = {p: (p * 7) % 23 for p in range(64)} | {40: 500}
    d = Directory(counts, capacity=40, max_depth=6)
    assert len(d.slots) == 1 << d.depth
    held = Counter()
    for p, n in counts.items():
        held[d.slots[p >> (6 - d.depth)]] += n
    assert all(held[b] == d.size[b] for b in range(len(d.size)))
    assert all(n <= 40 or d.local_depth[b] == 6 for b, n in enumerate(d.size))


def test_owners_take_whole_buckets_side_by_side(spark):
    draw = random.Random(3)
    keys = [draw.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows = spark.createDataFrame([(k % 7, i, k, b"x") for i, k in enumerate(keys)], "doc_id long, row long, key long, norm binary")
    index = directory(rows.select("key"), capacity=20, max_depth=10)
    owned_slots = owned(index, 6)
    slots = spark.createDataFrame(owned_slots, "slot int, bucket int, owner int")
    assert len({b for _, b, _ in owned_slots}) > 60
    assert [o for _, _, o in owned_slots] == sorted(o for _, _, o in owned_slots) and {o for _, _, o in owned_slots} == set(range(6))
    dealt = _owned_rows(bucketed(rows, index, slots), 6, "owner", F.col("doc_id").asc_nulls_last())
    held = [(r[0], r["bucket"], r["key"] % (1 << 64)) for r in dealt.select(F.spark_partition_id(), "bucket", "key").collect()]
    assert len({(p, b) for p, b, _ in held}) == len({b for _, b, _ in held})  # a bucket is in one task
    ends = sorted((min(k for q, _, k in held if q == p), max(k for q, _, k in held if q == p)) for p in {p for p, _, _ in held})
    assert len(ends) == 6 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    # Without one task, exactly the keys of its buckets are gone.
    lost = {k for p, _, k in held if p == 2}
    assert {k for p, _, k in held if p != 2} == {k % (1 << 64) for k in keys} - lost and lost


def test_exact_groups_of_rows_without_an_id(spark):
    """Thousands of rows under no id and one id, most of them copies: in proportion to the rows, each by its own text."""
    rows = [(None if i % 3 else 5, f"text {i % 50 if i % 4 else i}") for i in range(6000)]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), capacity=10, part_rows=30).collect()
    assert sorted((tuple(r) for r in got), key=ROW_KEY) == brute_exact(rows)


def brute_components(rows, words_=5):
    sets = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", lowered(t)) if x]
        sets.append((i, {tuple(w[k:k + words_]) for k in range(len(w) - words_ + 1)} if len(w) >= words_ else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                where[g].append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for o, n in Counter(o for g in s for o in where[g] if o < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[o][1]) - n):
                a, b = root(i), root(sets[o][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=ROW_KEY)


def test_jaccard_on_edges(edges, none):
    got = sorted((tuple(r) for r in jaccard_components(edges).collect()), key=ROW_KEY)
    assert got == brute_components(TEXTS)
    assert jaccard_components(none).collect() == []


def test_jaccard_on_near_copies(spark):
    """Chains of edits, a hot passage in many otherwise different texts, and a large group of near copies."""
    passage, rows = words(40, 9), []
    for k in range(40):
        rows.append((k, passage + " " + words(25, 100 + k)))
    base = words(120, 10).split()
    for k in range(60):
        edited = list(base)
        edited[k] = f"edit{k}"
        if k % 3 == 0:
            edited[(k + 50) % 120] = "other"
        rows.append((1000 + k, " ".join(edited)))
    chain = words(100, 11).split()
    for k in range(12):
        rows.append((2000 + k, " ".join(chain[k * 2:] + [f"tail{j}" for j in range(k * 2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=ROW_KEY)
    assert got == brute_components(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_jaccard_of_one_doc_id_with_several_texts(spark, parts):
    """Each text of a repeated doc_id keeps the links of its own set, and so do the others that have that set."""
    a, b, c = (words(60, 500 + k) for k in range(3))
    rows = [(5, a), (5, b), (1, a), (7, b + " tail"), (9, b), (20, c), (30, c), (30, a + " more"), (40, c + " end"), (50, words(60, 510))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=ROW_KEY)
    assert got == brute_components(rows)


def test_filters_lose_no_similar_pair():
    for k in range(40):
        a = words(40 + k, k).split()
        b = list(a)
        for j in range(k % 7):
            b[(j * 11) % len(b)] = "x"
        x, y = shingle_sets([" ".join(a), " ".join(b)])
        both = len(set(x.tolist()) & set(y.tolist()))
        near_ = 100 * both >= 80 * (len(x) + len(y) - both)
        assert similar(x, y) == near_
        assert not (near_ and apart(x, y))
        order = sorted(set(x.tolist()) | set(y.tolist()), key=lambda g: hashlib.md5(str(g).encode()).digest())
        first = [set([g for g in order if g in s][:prefix_length(len(s))]) for s in (set(x.tolist()), set(y.tolist()))]
        assert not near_ or first[0] & first[1]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(30)] + [(5, 5), (None, 7), (300, 299)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100} | {200 + i: 100 for i in range(30)} | {299: 299, 300: 299}


def brute_contamination(rows, tests, size=10):
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for item, text in tests:
        w = find(text) if item is not None else []
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, named = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    named |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=ROW_KEY)


ITEMS = [(1, " ".join(words(60, 1).split()[5:30])), (2, "zzz"), (3, "Àb c"), (4, None), (5, ""), (6, words(60, 4)), (6, words(60, 4)), (10, words(40, 5)),
         (None, words(60, 1)), (11, "a a a a a a a a a a a a"), (12, "!!!")]
MORE = [(50, "a " * 30), (51, "x " + " ".join(words(60, 4).split()[:15]) + " y " + " ".join(words(60, 4).split()[20:29]) + " " + words(60, 4)), (52, "ZZZ, zzz")]


def test_contamination_on_edges(spark, none):
    rows = TEXTS + MORE
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item long, term string").repartition(3)
    tests = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, row long")
    got = sorted((tuple(r) for r in contamination(docs, tests).collect()), key=ROW_KEY)
    assert got == brute_contamination(rows, ITEMS)
    assert contamination(none, tests).collect() == []
    assert contamination(docs, tests.limit(0)).filter("contaminated").count() == 0


def test_proximity_matches(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, phrase), (2, "one two three x four five six seven y eight nine ten"), (3, "ten nine"),
                                  (4, "one two three four five six seven eight nine " + "z " * 50 + "ten")], "doc_id long, text string")
    tests = items(spark.createDataFrame([(7, phrase)], "item_id long, text string"))
    postings = index(docs, tests.terms)
    assert {r["doc_id"] for r in near(tests.words, postings, 0).collect()} == {1}
    assert {r["doc_id"] for r in near(tests.words, postings, 3).collect()} == {1, 2}


def test_facts_take_little_memory(spark):
    """What a worker holds to hash a hand of texts and count its shingles is some ten times the text, and counts are of all shingles."""
    import tracemalloc

    import pyarrow as pa

    from tremor.llm import common, shingles

    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(200)]
    shingles._powers.clear()
    held = []

    def captured(df, function, schema, tokens=False):
        held.append(function)
        return df

    before, jaccard.mapped = jaccard.mapped, captured
    try:
        jaccard.facts(spark.createDataFrame([], "doc_id long, text string"), 5)
    finally:
        jaccard.mapped = before
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    tracemalloc.start()
    rows = list(held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in rows[-1].column("counts").to_pylist()])
    assert counts.sum() == 200 * 496 and len(rows[-1]) == common.CHUNKS


def test_batches_of_long_rows_are_closed_early(spark):
    """A batch on its way to a task's Python is bounded in bytes, not in rows alone."""
    import pyarrow as pa

    from tremor.llm.common import BATCH_BYTES, mapped

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    docs = spark.range(1000).coalesce(1).select("id", F.expr("repeat('text ', 4000)").alias("text"))
    got = mapped(docs, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 1000 and max(r["bytes"] for r in got) < 2 * BATCH_BYTES
