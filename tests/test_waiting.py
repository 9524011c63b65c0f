"""Payloads as streaming state, and an ingest that settles."""

import json
import time

import pytest

from panelyst.sources.publish import PanelStore
from panelyst.streaming.ingest import ingest_batch
from panelyst.streaming.waiting import append_whole, landed_text
from tests.test_ingest import codes, contents, dim, page, pages_at, row  # noqa: F401


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "landing").mkdir()
    return tmp_path / "landing"


def drain(spark, tmp_path, landing, **options):
    text = landed_text(spark, str(landing), 1)
    append_whole(text, str(tmp_path / "whole"), str(tmp_path / "progress"), **options).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "whole")).collect()
    return sorted((r.indicator, r.page, r.file.rsplit("/", 1)[1], r.rows, r.status) for r in rows)


def land(landing, name, body):
    (landing / name).write_text(body)
    time.sleep(0.02)  # the source takes files by their time


def test_pages_wait_and_are_taken_once(spark, tmp_path, landing):
    first, second = page([row("USA", 2000, 1)], 2, pages=2), page([row("IND", 2000, 2)], 2, number=2, pages=2)
    land(landing, "a2.json", second)  # out of order
    land(landing, "b.json", page([row("USA", 2000, 5, "IND.Y")], None))  # no total declared
    land(landing, "c.json", "broken")
    assert drain(spark, tmp_path, landing) == [("IND.Y", 1, "b.json", 1, "unknown")]
    land(landing, "a2-again.json", second)  # twice, while it waits, and with a restart between
    land(landing, "a1.json", first)
    want = [("IND.X", 1, "a1.json", 1, "complete"), ("IND.X", 2, "a2.json", 1, "complete"), ("IND.Y", 1, "b.json", 1, "unknown")]
    assert drain(spark, tmp_path, landing) == want
    land(landing, "d1.json", first)  # again, after it was taken
    assert drain(spark, tmp_path, landing) == want


def test_state_expires(spark, tmp_path, landing):
    land(landing, "a1.json", page([row("USA", 2000, 1)], 1))
    land(landing, "b1.json", page([row("USA", 2000, 1, "IND.Y")], 5))
    options = dict(remembered_ms=1, patience_ms=1)
    assert ("IND.X", 1, "a1.json", 1, "complete") in drain(spark, tmp_path, landing, **options)
    time.sleep(0.1)
    land(landing, "c.json", "broken")  # any batch fires the timers that are due
    land(landing, "d.json", "broken")
    assert ("IND.Y", 1, "b1.json", 1, "expired") in drain(spark, tmp_path, landing, **options)
    land(landing, "e1.json", page([row("USA", 2000, 1)], 1))  # forgotten, so it is new
    got = drain(spark, tmp_path, landing, **options)
    assert [r for r in got if r[0] == "IND.X"] == [("IND.X", 1, "a1.json", 1, "complete"), ("IND.X", 1, "e1.json", 1, "complete")]


def test_the_last_row_of_a_key_counts_and_settles(spark, dim, codes, tmp_path):  # noqa: F811
    store = PanelStore(spark, str(tmp_path / "store"))
    body = page([row("USA", 2000, "9.0"), row("USA", 2000, "1.0")], 2)
    assert ingest_batch(store, pages_at(spark, "a", body), dim, codes, 0, 1960, 2030) == {"total_current": "replaced"}
    assert [c[3] for c in contents(store)] == [1.0]
    assert ingest_batch(store, pages_at(spark, "b", body), dim, codes, 1, 1960, 2030) == {"total_current": "skipped"}
    # Over pages: the later page, whatever the files are called.
    two = [page([row("USA", 2000, "3")], 2, number=2, pages=2), page([row("USA", 2000, "8")], 2, number=1, pages=2)]
    ingest_batch(store, pages_at(spark, "c", *two), dim, codes, 2, 1960, 2030)
    assert [c[3] for c in contents(store)] == [3.0]


def test_a_page_that_lands_twice_does_not_block(spark, dim, codes, tmp_path):  # noqa: F811
    store = PanelStore(spark, str(tmp_path / "store"))
    one, two = page([row("USA", 2000, 1)], 2, pages=2), page([row("IND", 2000, 2)], 2, number=2, pages=2)
    assert ingest_batch(store, pages_at(spark, "a", one, two, two), dim, codes, 0, 1960, 2030) == {"total_current": "replaced"}
    assert [c[3] for c in contents(store)] == [2.0, 1.0]
    assert store.side_table("runs").first().pages_fetched == 2


def test_state_is_there_before_the_version_is(spark, dim, codes, tmp_path, monkeypatch):  # noqa: F811
    """A crash at the commit leaves no version without its state; the replay writes both."""
    store = PanelStore(spark, str(tmp_path / "store"))
    pages = pages_at(spark, "a", page([row("USA", 2000, 1)], 1))
    seen = []
    put = PanelStore.put

    def crash(self, name, version, rows):
        put(self, name, version, rows)
        seen.append((name, self.manifest()[0]))
        if name == "dataset_state" and len([s for s in seen if s[0] == name]) == 1:
            raise RuntimeError("crash")

    monkeypatch.setattr(PanelStore, "put", crash)
    with pytest.raises(RuntimeError):
        ingest_batch(store, pages, dim, codes, 0, 1960, 2030)
    assert store.manifest() == (-1, {}) and ("dataset_state", -1) in seen
    assert ingest_batch(store, pages, dim, codes, 0, 1960, 2030) == {"total_current": "replaced"}
    assert store.side_table("dataset_state").first().observation_count == 1
    assert json.dumps(store.manifest()[0]) == "0"
