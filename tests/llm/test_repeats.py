from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import llm.edge as edge
from tremor.llm import repeats


def plain(rows, length):
    """Every string of the length counted in a dictionary."""
    seen = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        edges = [i for i in range(len(b) + 1) if (i > 0 and gone[i - 1]) != (i < len(b) and gone[i])]
        spans = tuple((a, z - a) for a, z in zip(edges[::2], edges[1::2], strict=True))
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def found(df, length, **settings):
    rows = repeats.repeated_spans(df, length, **settings).collect()
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["length"]) for s in r["spans"]), bytes(r["kept"])) for r in rows), key=repr)


@pytest.mark.parametrize("v", repeats.COVERS)
def test_covers_have_a_common_shift_for_any_two_places(v):
    cover = set(repeats.COVERS[v])
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("length", [200, 20])
def test_edge_cases(spark, edges, length):
    assert found(edges, length) == plain([(r[0], r[1]) for r in edge.ROWS], length)


def test_empty_table(spark, none):
    assert found(none, 200) == []
    with pytest.raises(ValueError):
        repeats.repeated_spans(none, 5)


@pytest.mark.parametrize("seed, length, split", [(1, 20, 50_000), (2, 20, 3), (3, 45, 50_000), (4, 45, 5), (5, 9, 50_000), (6, 200, 4)])
def test_against_counting_every_string(spark, monkeypatch, seed, length, split):
    """Also over small blocks, buckets and segments, and with ranks of many contexts grouped over tasks."""
    draw = random.Random(seed)
    monkeypatch.setattr(repeats, "BLOCK", 700)
    monkeypatch.setattr(repeats, "BUCKET", 200)
    monkeypatch.setattr(repeats, "SORTED", 10)
    pool = ["".join(draw.choice("abcé ") for _ in range(draw.randint(5, 2 * length))) for _ in range(30)]
    piece = lambda: draw.choice(pool) if draw.random() < 0.6 else "".join(draw.choice("abcd") for _ in range(draw.randint(1, 2 * length)))
    rows = [(i, "".join(piece() for _ in range(draw.randint(0, 8)))) for i in range(120)] + [(200, "ab" * length), (201, "x" * 3 * length)]
    rows += [(300 + i, rows[5][1]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, length, split=split) == plain(rows, length)


def test_segments_hash_alike():
    data = np.random.default_rng(1).integers(0, 256, 3 * repeats.SEGMENT, dtype=np.uint8)
    data[2 * repeats.SEGMENT + 77:2 * repeats.SEGMENT + 377] = data[100:400]
    places = np.array([100, repeats.SEGMENT - 5, repeats.SEGMENT + 3, 2 * repeats.SEGMENT + 77])
    h = repeats.fingerprints(data, places, 300)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_strings_that_share_a_fingerprint_are_compared(monkeypatch):
    monkeypatch.setattr(repeats, "_powers", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    texts = [b"0123456789abcdefghijkl", b"0123456789abcdefghijkl", b"0123456789abcdeXghijkl"]
    marks = repeats.twins(np.array([2, 2, 2]), texts, 20)
    assert marks[:2, :3].all() and not marks[2].any()


def test_texts_are_dealt_once(spark):
    """Joins read blocks from buckets by their number and don't send the texts again; no table stays in the catalog."""
    from tremor.llm.repeats import repeated_spans

    docs = spark.createDataFrame([(i, f"{i} " * 90 + "shared words " * 30) for i in range(40)], "doc_id long, text string").repartition(3)
    found = repeated_spans(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "body" in line)
    assert "Bucketed: true" in scan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tremor_")]
    assert found.filter("size(spans) = 0").count() == 0
