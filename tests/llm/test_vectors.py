from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tremor.llm import vector_codes, whitening
from tremor.llm.bidiagonal import dqds, right_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row long, position int, entry int, v double, x long, error long, task int"


def vectors(n: int, width: int, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(3 * i, [float(np.float32(c + draw.gauss(0, 0.3))) for c in draw.choice(centres)], draw.choice([0, 1, 2, None])) for i in range(n)]


def odd() -> list[tuple]:
    """Rows to be dropped, rows of one id, without an id, and copies."""
    some = vectors(4, 16, 9)
    return [(7, None, 1), (8, [None] + [0.5] * 15, 1), (9, [float("nan")] * 16, 1), (10, [float("inf")] + [1.0] * 15, None),
            (11, [1.0] * 5, 2), (None, some[0][1], 1), (None, some[1][1], None), (12, some[2][1], 1), (12, some[3][1], 1), (13, some[2][1], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1.0, 1, 1, 1) for r in rows], SCHEMA).repartition(3)


def usable(rows, width):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts, entries, rounds):
    """The codes by plain loops."""
    rows = sorted(([i, [math.floor(256 * x) for x in v], label] for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1]) // parts
    cut = lambda v, p: tuple(v[p * size:(p + 1) * size])
    books = [[cut(r[1], p) for r in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members: dict[int, list] = {}
            for r in rows:
                members.setdefault(near(cut(r[1], p), books[p]), []).append(cut(r[1], p))
            for e, held in members.items():
                books[p][e] = tuple(sum(column) // len(held) for column in zip(*held, strict=True))
    out = []
    for i, v, label in rows:
        code = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for e in code), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code)), label])
    by_label = {la: sum(r[2] for r in out if r[3] == la) for la in {r[3] for r in out}}
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((r[0], r[1], r[2], by_label[r[3]], digest) for r in out), key=repr)


def codes(spark, rows, **settings):
    return sorted(map(tuple, vector_codes.vector_codes(frame(spark, rows), **settings).collect()), key=repr)


@pytest.mark.parametrize("n, parts, entries, rounds", [(150, 4, 8, 2), (150, 16, 5, 3), (3, 4, 8, 2), (40, 2, 64, 1), (30, 4, 4, 0)])
def test_codes_are_those_of_plain_loops(spark, n, parts, entries, rounds):
    rows = vectors(n, 16, n) + odd()
    assert codes(spark, rows, parts=parts, entries=entries, rounds=rounds) == plain_codes(usable(rows, 16), parts, entries, rounds)


def test_salts_and_small_blocks_change_nothing(spark, monkeypatch):
    rows = vectors(120, 16, 2) + [(1000 + i, [0.25] * 16, 1) for i in range(60)]
    monkeypatch.setattr(vector_codes, "SALT_ROWS", 20)
    monkeypatch.setattr(vector_codes, "MEMBERS", 3)
    assert codes(spark, rows, parts=4, entries=8) == plain_codes(rows, 4, 8, 2)


def test_only_parts_that_change_entry_migrate(spark):
    rows, width = vector_codes.whole_numbers(frame(spark, vectors(150, 16, 5)), "embedding", "vec_id", "label")
    generations, books = vector_codes.lloyd(rows, width, 4, 8, 3)
    first, *later = [sum(len(r["members"]) // 8 for r in g.collect()) for g in generations]
    assert first == 150 * 4 and len(later) == 2 and len(books) == 4
    for g in generations:
        for r in g.collect():
            parts = np.frombuffer(bytes(r["parts"]), np.int64).reshape(-1, 4)
            before = books[generations.index(g)][r["position"]]
            assert (vector_codes.nearest(parts, before)[0] == r["entry"]).all()
    assert later[0] < first and later[1] < first


def test_vectors_without_rows_or_equal_parts(spark):
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError):
        codes(spark, vectors(3, 10, 1), parts=4)


def plain_white(rows, k):
    x = np.array([[math.floor(64 * v) + 1000000 for v in r[1]] for r in rows], dtype=np.int64)
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    return centred @ vectors_[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation


@pytest.mark.parametrize("n, k", [(300, 16), (300, 5), (40, 32)])
def test_whitened_rows_are_those_of_the_covariance(spark, n, k):
    rows = vectors(n, 16, n) + odd()
    found = whitening.whiten(frame(spark, rows), components=k).collect()
    kept = usable(rows, 16)
    white, explained, deviation = plain_white(kept, k)
    assert len(found) == len(kept) * min(k, 16) and {r["n"] for r in found} == {len(kept)}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    for row, w, d in zip(kept, white, deviation, strict=True):
        if row[0] is None or row[0] in (12, 13):
            continue
        mine = by_id[row[0]]
        assert {r["deviation"] for r in mine.values()} == {d}
        assert [abs(mine[c + 1]["whitened"]) for c in range(min(k, 16))] == pytest.approx(np.abs(w), rel=1e-7, abs=1e-9)


def test_whitening_without_spread(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 4, 1)])).collect() == []
    flat = [(i, [float(i), 1.0, float(-i), 2.0], 1) for i in range(10)]
    assert {r["component"] for r in whitening.whiten(frame(spark, flat)).collect()} == {1}


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1_000_000], [1_000_000 + (1 << 36)]])
    assert whitening.deviations(x, 2, [2_000_000 + (1 << 36)]).to_pylist() == [None, None]
    assert whitening.deviations(x[:1], 1, [1_000_000]).to_pylist() == [0]


@pytest.mark.parametrize("kind", ["plain", "flat columns", "graded", "all equal", "twin columns", "rank one", "two clusters"])
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_qd_solver_against_svd(d, kind):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3 * d + 5, d))
    if kind == "flat columns":
        a[:, : d // 2] = 0
    elif kind == "graded":
        a *= np.logspace(0, -6, d)
    elif kind == "all equal":
        a = np.vstack([np.eye(d)] * 3)
    elif kind == "twin columns":
        a[:, -1] = a[:, 0]
    elif kind == "rank one":
        a = np.outer(np.arange(3 * d + 5), np.append(1.0, np.zeros(d - 1)))
    elif kind == "two clusters":
        a = np.linalg.qr(a)[0] * np.where(np.arange(d) < d // 2, 2.0, 1.0 + 1e-9 * np.arange(d))
    values, columns = right_vectors(np.linalg.qr(a, mode="r"))
    expected = np.linalg.svd(a, compute_uv=False) ** 2
    told = values > 1e-13 * d * values[0]
    assert values[told] == pytest.approx(expected[told], rel=1e-11)
    mine = columns[:, told]
    assert mine.T @ mine == pytest.approx(np.eye(told.sum()), abs=1e-10)
    assert a.T @ a @ mine == pytest.approx(mine * values[told], abs=1e-10 * values[0])


def test_dqds_keeps_small_values_to_high_relative_accuracy():
    diagonal, above = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([1.0, 1e-5, 1e-10])
    exact = dqds(diagonal ** 2, above ** 2)
    assert np.prod(exact) == pytest.approx(np.prod(diagonal ** 2), rel=1e-12)
