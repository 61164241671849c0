"""The conversion job gives each row once, whenever it is stopped and started again."""

from __future__ import annotations

import pytest

from sigflow.streaming import convert


def put(folder, name, first, n):
    lines = [f"{1.7e12 + (first + k) * 100:.0f},{first + k}.5,n{first + k}" for k in range(n)]
    (folder / name).write_text("\n".join(["time,v,note", *lines]) + "\n")


def test_each_row_once_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(3):
        put(folder, f"a{k}.csv", 10 * k, 10)

    def stop(batch):
        if batch == 1:
            raise RuntimeError("stopped")

    schema = "time double, v double, note string"
    with pytest.raises(Exception, match="stopped"):
        convert.convert(spark, str(folder), out, schema, "time", files_per_batch=1, then=stop)
    assert convert.recording(spark, out).count() == 10  # rows of a batch without a manifest are not there yet
    convert.convert(spark, str(folder), out, schema, "time", files_per_batch=1)
    put(folder, "b.csv", 30, 5)
    convert.convert(spark, str(folder), out, schema, "time", files_per_batch=1)
    convert.convert(spark, str(folder), out, schema, "time", files_per_batch=1)
    got = convert.recording(spark, out).orderBy("t").collect()
    assert [r["note"] for r in got] == [f"n{k}" for k in range(35)] and [r["v"] for r in got] == [k + 0.5 for k in range(35)]
    assert got[0]["t"] == 1.7e9 and abs(convert.rate(spark, out) - 10) < 1e-6
    assert sorted((r["file"], r["rows"]) for r in convert.manifest(spark, out).collect()) == [("a0.csv", 10), ("a1.csv", 10), ("a2.csv", 10), ("b.csv", 5)]


def test_row_counter_goes_on_from_file_to_file(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("v,s\n1, x \nNaN,N/A\ninf,z\nbad,\n")
    convert.convert(spark, str(folder), out, "v double, s string", freq=10.0)
    (folder / "b.csv").write_text("v,s\n5,y\n6,y\n")
    convert.convert(spark, str(folder), out, "v double, s string", freq=10.0)
    got = [(r["t"], r["v"], r["s"]) for r in convert.recording(spark, out).orderBy("t").collect()]
    assert got == [(0.0, 1.0, "x"), (0.1, None, None), (0.2, None, "z"), (0.3, None, None), (0.4, 5.0, "y"), (0.5, 6.0, "y")]


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    convert.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), "v double")
    assert convert.manifest(spark, str(tmp_path / "out")).count() == 0 and convert.rate(spark, str(tmp_path / "out")) is None
