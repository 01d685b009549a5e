"""Histories that grow by a stream, and rebuilds that fail half way."""

import datetime as dt
import random

import pytest

from ledgerloom.sources import history_store
from ledgerloom.streaming import histories

EVENTS = "account_id long, trade_date date, type string, amount double"


def _day(n):
    return dt.date(2023, 12, 1) + dt.timedelta(n)


def test_stream_of_late_rows_equals_a_rebuild(spark, tmp_path):
    rng, all_ = random.Random(8), []
    spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "600s")
    for part in range(4):
        rows = [(rng.randrange(5), _day(rng.randrange(25 * part // 2, 40)), rng.choice(["DEPOSIT", "WITHDRAWAL", "DIVIDEND", "FEE"]), rng.randint(-3_000, 9_000) / 100) for _ in range(60)] + [(None, _day(1), "FEE", 1.0), (1, None, "FEE", 1.0), (1, _day(2), "FEE", None), (9, _day(part % 2), "DEPOSIT", 5.0)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
        all_ += rows
        for _ in range(1 + (part == 2)):
            histories.stream_history(spark, spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in/*")), str(tmp_path / "store"), str(tmp_path / "checkpoint"))
        got = {(r.account_id, r.on): tuple(r)[2:] for r in histories.latest(spark.read.parquet(str(tmp_path / "store"))).collect()}
        want = {(r.account_id, r.on): tuple(r)[2:] for r in histories.cash_history(spark.createDataFrame(all_, EVENTS)).collect()}
        assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2:] == pytest.approx(want[k][2:], rel=1e-9) for k in want)


def test_rebuild_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    table = lambda rows: spark.createDataFrame(rows, "trade_date date, v int")
    read = lambda: sorted((r.trade_date, r.v) for r in history_store.read_history(spark, path).collect())
    assert history_store.read_history(spark, path, "trade_date date, v int").count() == 0
    with pytest.raises(FileNotFoundError):
        history_store.read_history(spark, path)
    first = [(dt.date(y, m, 5), y) for y in (2020, 2021, 2022, 2023) for m in (3, 9)]
    history_store.replace_history(table([*first, (None, 0)]), path)
    assert read() == first
    new = [(dt.date(2021, 7, 1), -1), (dt.date(2022, 3, 5), -2), (dt.date(2021, 1, 1), -3)]
    real = history_store._swap
    monkeypatch.setattr(history_store, "_swap", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        history_store.replace_history(table(new), path, from_date="2021-06-01")
    assert read() == first
    monkeypatch.setattr(history_store, "_swap", real)
    old = history_store.read_history(spark, path)
    history_store.replace_history(table(new), path, from_date="2021-06-01")
    assert read() == sorted([*first[:3], *new[:2]]) and old.count() == len(first)  # a reader of the version before still finds its files
    history_store.replace_history(table(new[:1]), path)
    assert read() == new[:1] and len(list((tmp_path / "history" / "data").iterdir())) == 3
    history_store.replace_history(table([]), path, from_date="2030-01-01")
    assert read() == new[:1]
