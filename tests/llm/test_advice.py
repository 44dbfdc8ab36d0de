"""Places where an operator once did less than the whole job."""

import tracemalloc

import re

import numpy as np
import pytest

from tidegate.llm import keyed, pii, quality_rules, topk


def test_rows_keep_their_names_when_a_scan_is_packed_otherwise(spark, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "docs")
    rows = [(i, " ".join(f"w{i // 2 if i % 4 < 2 else i}x{j}" for j in range(30)), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(10).write.parquet(path)
    expected = sorted(spark.read.parquet(path).groupBy("text").count().select("text").toPandas()["text"])
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        kept = corpus_pipeline.near_duplicates_stage(spark, spark.read.parquet(path), "")
        spark.conf.set("spark.sql.files.minPartitionNum", "20")  # as when executors join between two jobs
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
        assert sorted(r["text"] for r in kept.select("text").collect()) == expected
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_every_query_reads_sorted_lists(monkeypatch):
    draw = np.random.default_rng(7)
    rows = np.floor(draw.normal(size=(4000, 64)))
    rows[:40] = np.floor(1000 * draw.normal(size=(40, 64)))
    ids, k = np.arange(4000), 5
    scored, best = [], topk.SortedLists._best
    monkeypatch.setattr(topk.SortedLists, "_best", staticmethod(lambda r, s, k: scored.append(len(r)) or best(r, s, k)))
    found = topk.SortedLists(ids, rows).search(ids[:8], rows[:8], k)
    assert len(scored) == 8 and max(scored) < 3999  # one step each, and rows that no list showed are not scored
    for q, (got, scores) in enumerate(found):
        expected = sorted((-(rows[i] @ rows[q]), i) for i in range(4000) if i != q)[:k]
        assert [(-s, i) for i, s in zip(got, scores, strict=True)] == expected


def test_one_long_text_does_not_pad_the_others():
    draw = np.random.default_rng(2)
    documents = [draw.normal(size=(n, quality_rules.FEATURES)) for n in [*draw.integers(1, 20, 600), 6000]]
    tracemalloc.start()
    quality_rules.fit_field(documents, np.arange(601) % 2, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_groups_of_like_length_fit_the_same_field(monkeypatch):
    draw = np.random.default_rng(4)
    documents = [draw.normal(size=(n, quality_rules.FEATURES)) for n in draw.integers(1, 30, 60)]
    whole = quality_rules.fit_field(documents, np.arange(60) % 2, rounds=20)
    monkeypatch.setattr(quality_rules, "CELLS", 50)
    parts = quality_rules.fit_field(documents, np.arange(60) % 2, rounds=20)
    np.testing.assert_allclose(parts.emit, whole.emit, rtol=1e-6)
    np.testing.assert_allclose(parts.step, whole.step, rtol=1e-6)


@pytest.mark.parametrize("address", ["jane [At] foo [dot] com", "jane (at] foo.com", "jane ( at) foo.com", "jane {aT } foo (dot) com"])
def test_written_out_addresses_in_every_form(address):
    text = f"mail {address}"
    assert (5, len(text), "email") in pii.loose_spans(text, [])


@pytest.mark.parametrize("address", ["a" * 90 + " [at] foo.com", "jane [at] a.b.c.d.e.f.g.h.i.com", "jane [at] " + "d" * 80 + ".com", "j" * 40_000 + "[at]x.de"])
def test_written_out_addresses_of_any_length_are_whole(address):
    assert pii.loose_spans(f"mail {address} now", []) == [(5, 5 + len(address), "email")]


def plain_failed(text):
    """Failing matches near to what passes, by the plain patterns and in plain words, where no passing one is."""
    taken, found = [(s, e) for s, e, _ in pii.strict_spans(text)], []
    for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        parts = m[0].split(".")
        if max(map(len, parts)) < 4 and max(map(int, parts)) > 255:
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        luhn = sum(d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(digits)) % 10 == 0
        if len(digits) in (13, 20) or (14 <= len(digits) <= 19 and not luhn):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if sum(c.isdigit() for c in m[0]) in (7, 8, 9, 16, 17):
            found.append((m.start(), 3, m.end(), "phone"))
    out = []
    for s, _, e, kind in sorted(found):
        if all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            out.append((s, e, kind))
    return out


def test_failed_matches_are_candidates():
    draw = np.random.default_rng(9)
    found = 0
    for _ in range(3000):
        pieces = ["1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111 1111 1111 1112", "+1 555 12", "+1 (743) 555-3824", "+123", "12", ".", " ", "-", "7086638319846192", "1234.5.6.7", "x", "+49 (30) 1234-5678 90 12 34"]
        text = "".join(draw.choice(pieces, draw.integers(1, 7)))
        mine = [s for s in pii.loose_spans(text, pii.strict_spans(text))]
        if not any(p.search(text) for p in (pii._NATIONAL, pii._DOTTED_CARD)):
            assert mine == plain_failed(text), text
            found += len(mine)
    assert found > 500


def test_the_classifier_refuses_look_alikes(spark):
    """Card-like numbers that fail their sum are candidates that the votes make negatives: none is added, cards stay."""
    draw = np.random.default_rng(2)
    number = lambda ok: next(n for n in iter(lambda: "4" + "".join(map(str, draw.integers(0, 10, 15))), None) if pii.luhn(n) == ok)
    texts = [f"pay by card {number(True)} today" if k % 2 else f"part {number(False)} of stock" for k in range(120)]
    rows = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(r["n_card"] == k % 2 and r["n_added"] == 0 for k, r in rows.items())
    assert sum(len(pii.loose_spans(t, pii.strict_spans(t))) for t in texts) == 60


def test_counts_beyond_32_bits():
    counts, totals = keyed.add_counts(np.array([0, 0, 1]), [np.array([2**31 - 1, 2**31 - 1, 3], np.int32)])
    assert counts[0].tolist() == [2**32 - 2, 2**32 - 2, 3] and totals[0] == 2**32 + 1
    assert keyed.decode(keyed.encode(counts[0]), np.int64, 3).tolist() == counts[0].tolist()
