"""Reading recordings: quotes, header and start rows, encodings, null tokens, ragged rows, types, limits, bits."""

from __future__ import annotations

import pytest

from sigflow.operators import downsample, segments
from sigflow.sources import io


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_plain_csv_with_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' a ,b,c\n1,1.5,x\n2,NaN,"y,z"\n3,2,N/A\n4,5\n')
    df = io.read_csv(spark, str(tmp_path / "a.csv"), infer=True)
    assert df.columns == ["a", "b", "c"] and [f.dataType.simpleString() for f in df.schema.fields][0] == "bigint"
    assert [r["a"] for r in df.collect()] == [1, 2, 3] and df.where("c = 'y,z'").count() == 1
    assert rows(df.select("a")) == [(1,), (2,), (3,)]


def test_header_and_start_rows(spark, tmp_path):
    lines = ["Title", "Made by x", "t;v;note"] + ["s;m;-"] + [f'{k};{k}.5;"n;{k}"' for k in range(40)] + ["7;8"]
    (tmp_path / "b.csv").write_bytes("\n".join(lines + ["9;9,5;é"]).encode("latin-1"))
    df = io.read_csv(spark, str(tmp_path / "b.csv"), sep=";", header_row=2, start_row=24, encoding="ISO-8859-1")
    got = rows(df)
    assert got[0] == ("20", "20.5", "n;20") and len(got) == 21 and got[-1] == ("9", "9,5", "é")
    assert io.read_csv(spark, str(tmp_path / "b.csv"), sep=";", header_row=2, start_row=900).count() == 0


def test_lines_wrapped_in_quotes(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\n".join(f'"{x}"' for x in ("t,v", "1,2", "3,4")))
    assert rows(io.read_csv(spark, str(tmp_path / "c.csv"), repair_quotes=True, infer=True)) == [(1, 2), (3, 4)]


def test_limits_and_bits(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Parameter,Warning_Min,Warning_Max\nrpm,,90\n")
    assert rows(io.limits(io.read_csv(spark, str(tmp_path / "l.csv")))) == [("rpm", 0.0, 90.0)]
    with pytest.raises(ValueError):
        io.limits(spark.createDataFrame([(1,)], "Parameter int"))
    (tmp_path / "d.csv").write_text("bit,description\n0,on\nx,bad\n3,hot\n")
    assert rows(io.bit_definitions(spark, {"s": str(tmp_path / "d.csv")})) == [("s", 0, "on"), ("s", 3, "hot")]


def test_overlapping_segments_and_nulls(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(10)] + [("b", 1.0), (None, 1.0), ("a", None)], "k string, x double")
    segs = spark.createDataFrame([("a", 1.0, 6.0), ("a", 2.0, 3.0), ("a", 8.0, 8.0), (None, 0.0, 9.0)], "k string, s double, e double")
    inside = sorted(r["x"] for r in segments.in_segments(df, segs, ["k"], "x", "s", "e").collect())
    assert inside == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0]
    assert segments.in_segments(df, segs, ["k"], "x", "s", "e", "left_anti").count() == df.count() - 7


def test_auto_downsampling(spark):
    df = spark.createDataFrame([("a", float(k), float(k % 7)) for k in range(900)], "k string, t double, v double")
    assert downsample.auto(df, ["k"], ["t"], "t", "v", 450).count() == 900
    assert downsample.auto(df, ["k"], ["t"], "t", "v", 50).count() == 100
    got = {r["row_idx"] for r in downsample.auto(df, ["k"], ["t"], "t", "v", 50, limits=[5.5]).collect()}
    assert 3 <= len(got) <= 150
