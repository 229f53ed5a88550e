"""Language identification, quality ranking, and the pipeline."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from llm.edge import TEXTS
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from tremor import session
from tremor.llm import language, quality_rank
from tremor.llm.boosting import boost, calibrate
from tremor.session import outcome, work_area, written


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_edges(spark, edges, none):
    rows = language.identify(edges).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r["doc_id"] in (4, 5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.identify(none).collect() == []
    unlabelled = edges.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_prediction_looks_at_the_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.learnable(docs).select("doc_id", "text", "lang"))
    changed = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang")
    a = {r["doc_id"]: tuple(r)[1:] for r in language.predict(docs, model).collect()}
    b = {r["doc_id"] - 1000000: tuple(r)[1:] for r in language.predict(changed, model).collect()}
    assert a == b


def plain_buckets(text):
    """Bucket -> count of a text's n-grams, one character after the other."""
    mask, (f0, f1, f2) = 0xFFFFFFFF, (int(f) for f in language._FACTORS)
    text, spaced = text.lower(), " "
    for i, c in enumerate(text):
        if c.isalpha():
            spaced += c
        elif i and text[i - 1].isalpha():
            spaced += " "
    spaced += " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(spaced) - n + 1):
            h = (ord(spaced[i]) * f0 + 1) & mask
            for c in spaced[i + 1:i + n]:
                h = ((h ^ h >> 15) * f1 + ord(c) * f2) & mask
            h = (h ^ h >> 13) * f2 & mask
            b = (h ^ h >> 16) >> (32 - language.BITS)
            counts[b] = counts.get(b, 0) + 1
    return counts


def test_predictions_are_those_of_a_plain_softmax(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(language.learnable(docs))
    rows = [*docs.limit(60).collect(), *edges.select("doc_id", "text", "lang").collect()]
    got = language.predict(spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]]["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        counts = plain_buckets(text)
        total = sum(counts.values())
        z = [(float(model.bias[k]) + sum(n / total * float(model.weights[b, k]) for b, n in counts.items())) / model.temperature for k in range(len(model.languages))]
        p = [np.exp(x - max(z)) for x in z]
        assert r["score"] == pytest.approx(max(p) / sum(p), rel=1e-5) and r["lang_pred"] == model.languages[p.index(max(p))]


def test_scores_are_those_of_plain_weights(spark, edges):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = quality_rank.written(quality_rank.measured(docs.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))), "measures")
    ranker = quality_rank.trained(known, labels)
    scored = quality_rank.mapped(known, quality_rank._scorer(ranker.scores, "score"), "doc_id long, score double").collect()
    plain = []
    for r in known.collect():
        raw, at = 0.0, 0
        for value, edges_ in zip(r["measures"], ranker.edges, strict=True):
            raw += float(ranker.weights[at + sum(value >= e for e in edges_)])
            at += len(edges_) + 1
        plain.append((str(r["doc_id"]), 1 / (1 + np.exp(-(raw - ranker.threshold) / ranker.scale))))
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in scored) == sorted((i, round(float(x), 9)) for i, x in plain)


def test_temperature_softens_overconfidence():
    draw = np.random.default_rng(1)
    labels = draw.integers(0, 3, 3000)
    logits = draw.normal(size=(3000, 3))
    logits[np.arange(3000), labels] += 1.0
    assert 3 < language.calibrate(logits * 8, labels) < 14


def test_quality_held_out_accuracy(spark, edges, none):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_rank.rank(docs, labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.9 * len(held)
    odd = labels.unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)
    rows = quality_rank.rank(edges, odd).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality_rank.rank(none, labels).collect() == []
    assert {r["score"] for r in quality_rank.rank(edges, labels.limit(0)).collect()} == {0.5}


def test_threshold_is_of_all_training_rows(spark):
    """Learned from a few rows, the share predicted 0 among all labelled training rows is still that of label 0."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = quality_rank.written(quality_rank.measured(docs), "measures")
    usable = quality_rank.learnable(labels)
    for rows in (8, 20):
        ranker = quality_rank.trained(known, labels, rows)
        got = known.join(usable, "doc_id").collect()
        raw = np.sort(ranker.raw(np.array([r["measures"] for r in got])))
        zeros = sum(r["quality"] == 0 for r in got)
        assert ranker.threshold == (raw[zeros - 1] + raw[zeros]) / 2
        assert abs(4 * ranker.scale - raw.std()) < 1e-6 * raw.std()


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(quality_rank, "SORTED", 3)
    draw = np.random.default_rng(4)
    values = [*np.round(draw.normal(size=500), 1).tolist(), *(1e-12 * draw.normal(size=200)).tolist(), 1e9, -1e9]
    raw = spark.createDataFrame([(v,) for v in values], "raw double").cache()
    for at in (0, 1, 250, 350, 400, 600, len(values) - 1):
        assert quality_rank.order_statistic(raw, at) == sorted(values)[at]


def test_ranker_orders_preferences():
    draw = np.random.default_rng(2)
    values = draw.normal(size=(400, len(quality_rank.MEASURES)))
    labels = (np.abs(values[:, 3]) < 1).astype(int)  # a middle value is best
    ranker = quality_rank.fit(values, labels, share=float((labels == 0).mean()), pairs=4000)
    assert ((ranker.scores(values) >= 0.5) == labels).mean() > 0.93


def test_boosting_learns_an_interaction_and_is_calibrated():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:3000], y[:3000])
    calibrate(model, x[3000:3500], y[3000:3500])
    p = model.probability(x[3500:])
    assert ((p > 0.5) == y[3500:]).mean() > 0.95


def test_pipeline_stages(spark):
    """Each stage against brute force on what the stage before it kept."""
    from llm.test_sets import brute_components, brute_contamination, brute_exact

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tests = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {i for i, _ in before}
            break
        assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            assert kept >= {i for i, t in before if t and len(t) > 60}
        elif name == "exact_dedup":
            assert kept == {r[0] for r in brute_exact(before) if r[3]}
        elif name == "near_dedup":
            assert kept == {r[0] for r in brute_components(before) if r[2] == r[0]}
        else:
            assert kept == {r[0] for r in brute_contamination(before, tests) if not r[5]}
        docs = out


def test_pipeline_decides_by_row(spark, tmp_path):
    """Rows with a null doc_id, and rows that repeat one, are each decided by their own text in every stage."""
    from llm.edge import words

    a, b, c, d, e = (words(60, 300 + k) for k in range(5))
    passage = words(25, 400)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string"

    def stage(name, rows):
        docs = spark.createDataFrame([(i, t, "en", f"s{k}") for k, (i, t) in enumerate(rows)], schema).coalesce(1)
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        return sorted(int(r["source"][1:]) for r in out.collect())

    # One row of each group: the least doc_id, null last, else the first; the rest go, whatever else their id holds.
    assert stage("exact_dedup", [(5, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, b), (8, d), (8, a), (2, d)]) == [0, 2, 4, 9]
    assert stage("near_dedup", [(None, a + " x y"), (None, b), (5, a), (5, c), (9, c + " z"), (None, d), (None, d + " x"), (4, e), (4, e + " q")]) == [1, 2, 3, 5, 7]
    bad = f"{a} {passage} {b}"
    assert stage("decontamination", [(None, bad), (None, a), (5, bad), (5, b), (6, c), (6, f"{c} {passage}"), (7, d)]) == [1, 3, 4, 6]
    prose = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(40).collect())]
    n = len(prose)
    odd = [(None, "!!!"), (None, prose[0][1]), (3, "1234 ..."), (3, prose[3][1])]
    kept = stage("language_id", prose + odd)
    assert n not in kept and n + 2 not in kept and {n + 1, n + 3} <= set(kept)


@pytest.fixture
def shared(tmp_path, monkeypatch):
    """A shared folder of the test's own."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path / "shared"))
    (tmp_path / "shared").mkdir()
    return lambda: sorted(p.name.rpartition("-")[0] for p in (tmp_path / "shared").iterdir())


def test_pipeline_deletes_what_its_decisions_took(spark, tmp_path, shared):
    """Of all tables that a stage writes, those that its frame reads are left: whole rows once, and keys of rows."""
    from llm.edge import words

    texts = [words(60, 500 + k) for k in range(6)]
    spark.createDataFrame([(1, words(25, 600))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[1] + " more"])), "doc_id long, text string")
    tables = []
    for name, kept in (("exact_dedup", 7), ("near_dedup", 6), ("decontamination", 8)):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        tables = sorted([*tables, "gone", "ids", "rows"])
        assert shared() == tables
        assert out.count() == kept


def test_work_area_ends_with_its_tables(spark, shared):
    """Areas may lie in one another, and go when something fails, too; paths named outside stay."""
    stays = written(spark.range(3), "stays")

    def made():
        held = outcome(spark, "inner", lambda: written(spark.range(5), "first").filter("id > 1"))
        assert held.count() == 3 and len(shared()) == 2
        return held.join(stays, "id")

    assert [r["id"] for r in outcome(spark, "outer", made).collect()] == [2]
    with pytest.raises(ZeroDivisionError), work_area(spark):
        written(spark.range(1), "lost").filter(str(1 // 0))
    assert shared() == ["outer", "stays"]


def test_pipeline_stages_on_edges(spark, edges, none, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of the stages' own names; and no rows at all."""
    spark.createDataFrame([(1, "some words that no text here holds at all, ten or more")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (edges, none):
        docs = table.withColumns({c: F.lit(1) for c in ("corpus_row", "document", "corpus_doc_id", "own", "group", "first")})
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert out.select("doc_id", "piece").count() >= docs.count()
                continue
            assert out.columns == docs.columns and out.count() <= docs.count()
            assert name == "decontamination" or docs.isEmpty() or 0 < out.count() < docs.count()
            assert name != "decontamination" or out.count() == docs.count()
        assert docs.isEmpty() or corpus_pipeline.language_id(spark, docs, str(tmp_path)).columns == docs.columns
