"""Archives read by ranges of rows: layouts, pruning, and what is refused."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

from tidegate.errors import LimitError, SourceError
from tidegate.sources import arrays, npz
from tidegate.sources.files import Limits

DAYS = np.arange("2020-01-01", "2020-02-10", dtype="datetime64[D]")
IDS = np.array(["x", "ÿy", "longer name"])


def archive(path, save=np.savez, order="C", **more):
    draw = np.random.default_rng(1)
    found = {"sessions": DAYS, "asset_ids": IDS, "signal_prices": np.asarray(draw.uniform(1, 2, (40, 3)), order=order), "tradable_returns": np.asarray(draw.normal(0, 1, (40, 3)).astype("f4"), order=order)}
    save(path, **(found | more))
    return found


@pytest.mark.parametrize(("save", "order"), [(np.savez, "C"), (np.savez, "F"), (np.savez_compressed, "C"), (np.savez_compressed, "F")])
def test_every_layout(spark, tmp_path, monkeypatch, save, order):
    found = archive(tmp_path / "p.npz", save, order)
    reader = npz.NpzReader(str(tmp_path / "p.npz"), "panel", Limits())
    monkeypatch.setattr(npz, "TASK_CELLS", 30)
    monkeypatch.setattr(npz, "BATCH_CELLS", 12)
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 10), (10, 20), (20, 30), (30, 40)]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 120 and all(r["price"] == found["signal_prices"][r["t"], r["asset_idx"]] and r["ret"] == float(found["tradable_returns"][r["t"], r["asset_idx"]]) and r["asset"] == IDS[r["asset_idx"]] for r in rows)
    got = arrays.read_panel(spark, str(tmp_path / "p.npz"))
    assert sorted((r["t"], r["asset_idx"], r["price"]) for r in got.collect()) == [(r["t"], r["asset_idx"], r["price"]) for r in rows]
    assert {str(r["session"])[:10] for r in got.where("t = 39").collect()} == {"2020-02-09"}


def test_ranges_are_pruned(spark, tmp_path):
    archive(tmp_path / "p.npz")
    reader = npz.NpzReader(str(tmp_path / "p.npz"), "panel", Limits())
    left = list(reader.pushFilters([IsNotNull(("t",)), GreaterThan(("t",), 5), LessThanOrEqual(("t",), 9), EqualTo(("asset",), "x")]))
    assert len(left) == 2 and [(p.first, p.last) for p in reader.partitions()] == [(6, 10)]
    assert [(p.first, p.last) for p in npz.NpzReader(str(tmp_path / "p.npz"), "panel", Limits()).partitions()] == [(0, 40)]
    rows = arrays.read_panel(spark, str(tmp_path / "p.npz"))
    assert rows.where("t > 5 and t <= 9 and asset = 'x'").count() == 4 and rows.where("t = 50").count() == 0 and rows.where("t = 3").count() == 3


@pytest.mark.parametrize(("more", "message"), [
    ({"extra": np.zeros(1)}, "members"), ({"asset_ids": np.array(["x", "x", "y"])}, "distinct"), ({"asset_ids": np.array([1, 2, 3])}, "strings"), ({"asset_ids": np.array(["x", "y"])}, "sessions by ids"),
    ({"signal_prices": np.array([["a"] * 3] * 40)}, "finite"), ({"sessions": DAYS[:39]}, "sessions by ids"),
])
def test_refused_archives(spark, tmp_path, more, message):
    archive(tmp_path / "p.npz", **more)
    with pytest.raises(SourceError, match=message):
        arrays.read_panel(spark, str(tmp_path / "p.npz"))


def test_other_refusals(spark, tmp_path):
    archive(tmp_path / "p.npz")
    with pytest.raises(SourceError, match="members"):
        arrays.read_returns(spark, str(tmp_path / "p.npz"))
    with pytest.raises(LimitError, match="too large"):
        arrays.read_panel(spark, str(tmp_path / "p.npz"), Limits(file_bytes=100))
    (tmp_path / "q.npz").write_text("text")
    for path in ("q.npz", "none.npz", "p.txt"):
        with pytest.raises(SourceError, match="npz"):
            arrays.read_panel(spark, str(tmp_path / path))
    bad = np.ones((40, 3))
    bad[17, 1] = np.inf
    archive(tmp_path / "r.npz", signal_prices=bad)
    rows = arrays.read_panel(spark, str(tmp_path / "r.npz"))  # headers are sound; values are seen by the tasks alone
    with pytest.raises(PySparkException, match="finite"):
        rows.count()
    archive(tmp_path / "e.npz", sessions=DAYS[:0], signal_prices=np.ones((0, 3)), tradable_returns=np.ones((0, 3)))
    assert arrays.read_panel(spark, str(tmp_path / "e.npz")).count() == 0
