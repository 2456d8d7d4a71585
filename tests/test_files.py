"""File sources and sinks: round trips on small files."""

import datetime as dt

from pyspark.sql import functions as F

import random

import numpy as np
import pytest

from skyloom.sources.files import numbered_lines, scan_csv, scan_points, write_monthly, write_report
from skyloom.sources.rasters import RasterReader, scan_rasters, write_rasters


def test_csv_with_preamble_and_encoding(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("Title\nnotes, more\nsite;v\nÉté;1.5\nbroken\nb;\n".encode("latin1"))
    got = scan_csv(spark, str(p), "site string, v double", ";", "ISO-8859-1", 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("Été", 1.5), ("b", None)], key=str)


def test_csv_leaves_bad_lines_out(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("site,v\na,1\nb,2,3,4\n")
    assert [tuple(r) for r in scan_csv(spark, str(p), "site string, v double").collect()] == [("a", 1.0)]


def test_points(spark, tmp_path):
    rows = [("SPO/A1", dt.datetime(2020, 5, 1), 1.0), ("SPO/A1", dt.datetime(2021, 5, 1), 2.0)]
    schema = "Samplingpoint string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "p1"))
    assert [(r.site, r.value) for r in scan_points(spark, str(tmp_path / "p*"), schema, 2020).collect()] == [("A1", 1.0)]


def test_monthly_sink_overwrites_its_months_only(spark, tmp_path):
    path = str(tmp_path / "maps")
    df = spark.createDataFrame([(1, 1, 2020, 1, 5.0, 1), (1, 1, 2020, 2, 6.0, 1)], "ilat int, ilon int, year int, mon int, v double, extra int")
    write_monthly(df, path, ["ilat", "ilon", "v"], {"v": {"units": "ppb"}})
    write_monthly(df.where("mon = 2").withColumn("v", F.lit(7.0)), path, ["ilat", "ilon", "v"])
    back = spark.read.parquet(path)
    assert "extra" not in back.columns
    assert sorted((r.mon, r.v) for r in back.collect()) == [(1, 5.0), (2, 7.0)]


def test_report(spark, tmp_path):
    write_report(spark.createDataFrame([("a", "annual", "r2", 0.5)], "area string, period string, metric string, value double"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1


@pytest.fixture
def small_splits(spark):
    """Files of a few hundred bytes are cut into several splits."""
    keys = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE"])
def test_line_numbers_over_splits(spark, small_splits, tmp_path, encoding):
    want = []
    for f in range(3):
        lines = [f"{'é' * (k % 7)} line {k} of {f}" for k in range(60 + f)]
        mark = "\ufeff" if encoding.startswith("UTF-16") else ""
        (tmp_path / f"{f}.txt").write_bytes((mark + "\r\n".join(lines)).encode(encoding))
        want += [(f, k, x) for k, x in enumerate(lines)]
    df = numbered_lines(spark, str(tmp_path), encoding)
    assert df.select("_file", "_block").distinct().count() > 6
    got = [(int(r._file.rsplit("/", 1)[-1].removesuffix(".txt")), r._at, r.line) for r in df.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16LE"])
def test_breaks_in_quotes_over_splits(spark, small_splits, tmp_path, encoding):
    """Records with line breaks, doubled quotes and separators, wherever the splits fall; preamble quotes do not count."""
    rng, want = random.Random(5), []
    for f in range(4):
        out = ["title", 'a lone " quote', "id;note;v"]
        for k in range(50):
            note = "".join(rng.choice(["a", "\n", ";", '"', "é", " "]) for _ in range(rng.randrange(1, 30)))
            quoted = rng.random() < 0.6
            if not quoted:
                note = note.translate(str.maketrans("", "", '\n;"')).strip() or "x"
            out.append(f"{k};" + ('"' + note.replace('"', '""') + '"' if quoted else note) + f";{k / 4}")
            want.append((k, note, k / 4))
        out += ["not;enough", "1;too;2.0;many"]
        (tmp_path / f"{f}.csv").write_bytes("\n".join(out).encode(encoding))
    df = scan_csv(spark, str(tmp_path), "id long, note string, v double", ";", encoding, 2, True)
    got = [tuple(r) for r in df.collect() if r.v is not None]
    # blank ends of quoted fields are the parser's matter
    strip = lambda rows: sorted((i, n.strip(" "), v) for i, n, v in rows)
    assert strip((i, n or "", v) for i, n, v in got) == strip(want)


def raster_files(tmp_path):
    rng, out = np.random.default_rng(3), {}
    for name, shape, kind in (("a", (40, 6), "<f8"), ("b", (7, 3), "<f4"), ("c", (30, 5), ">i4"), ("f", (25, 4), "<f8"), ("empty", (0, 4), "<f8")):
        x = (rng.normal(0, 100, shape)).astype(kind)
        if x.dtype.kind == "f" and x.size:
            x[1, 2] = np.nan
        np.save(tmp_path / f"{name}.npy", np.asfortranarray(x) if name == "f" else x)
        out |= {(name, i, j): None if x.dtype.kind == "f" and np.isnan(v) else float(v) for (i, j), v in np.ndenumerate(x)}
    return out


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_raster_scan(spark, tmp_path, block):
    """Every cell once, whatever the blocks, the order in the file and the type; bounds of the latitude reach the scan."""
    want = raster_files(tmp_path)
    df = scan_rasters(spark, str(tmp_path), -10.0, 0.5, block)
    assert {(r.file, r.ilat, r.ilon): r.v for r in df.collect()} == want and df.count() == len(want)
    if block == 100:
        assert df.rdd.getNumPartitions() > 15
    part = df.where("lat >= -8.5 and lat < -2 and v is not null")
    assert {(r.file, r.ilat, r.ilon): r.v for r in part.collect()} == {k: v for k, v in want.items() if -8.5 <= -10 + k[1] * 0.5 < -2 and v is not None}
    assert df.where("lat = 3").count() == 6 + 5  # row 26 of two of the files


def test_raster_bounds_skip_rows(tmp_path):
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    raster_files(tmp_path)
    r = RasterReader({"path": str(tmp_path), "lat0": "-10", "step": "0.5", "block": "100"})
    left = list(r.pushFilters([GreaterThan(("lat",), -8.0), LessThanOrEqual(("lat",), -6.0)]))
    assert len(left) == 2  # Spark checks them again
    rows = {i for p in r.partitions() for b in r.read(p) for i in b.column(1).to_pylist()}
    assert rows == {4, 5, 6, 7, 8}


def test_raster_of_three_axes_is_refused(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="3 axes"):
        scan_rasters(spark, str(tmp_path), 0.0, 1.0).collect()


def test_rasters_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 2, 3, None), ("q", 1, 1, 5.0)], "file string, ilat long, ilon long, v double")
    write_rasters(cells, f"file://{tmp_path}/new", "file", 3, 4)
    got = scan_rasters(spark, f"file://{tmp_path}/new", 0.0, 1.0)
    assert got.count() == 24 and sorted((r.file, r.ilat, r.ilon, r.v) for r in got.where("v is not null").collect()) == [("p", 0, 0, 1.0), ("q", 1, 1, 5.0)]
