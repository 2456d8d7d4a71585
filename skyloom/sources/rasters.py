"""Rasters in NumPy's file format as a data source: ``spark.read.format("rasters")``.

A file is cut into blocks of ``block`` bytes by its size alone, so the driver only lists files. A task reads the header
of its file, works out which rows of the grid are its own, and reads their bytes only. Conditions on ``lat`` are pushed down
to the rows: what they leave out is never read.

Options: ``path`` (a file, or a folder whose ``*.npy`` files are read; any file system that pyarrow opens), ``lat0`` and
``step`` (latitude of the first row's cells, and between rows), ``block``. Columns: file (its name without the ending), ilat,
ilon, lat, v; NaN becomes null. Files with another number of axes than two are refused.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

BLOCK = 32 << 20
_SCHEMA = "file string, ilat long, ilon long, lat double, v double"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def header(f) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, Fortran order, type and place of the first value of an open file."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return *read(f), f.tell()


@dataclass
class Block(InputPartition):
    path: str
    number: int
    of: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.lat0, self.step = options["path"], float(options.get("lat0", 0)), float(options.get("step", 1))
        self.block, self.low, self.high = int(options.get("block", BLOCK)), -math.inf, math.inf

    def pushFilters(self, filters):
        """Bounds of ``lat`` are kept here as well; Spark checks every condition again, so only rows must not be lost."""
        for f in filters:
            if getattr(f, "attribute", None) == ("lat",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, float(f.value))
            yield f

    def partitions(self) -> list[Block]:
        system, path = opened(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.path.endswith(".npy")]
        blocks = [(x.path, max(1, math.ceil(x.size / self.block))) for x in sorted(files, key=lambda x: x.path)]
        return [Block(p, k, n) for p, n in blocks for k in range(n)]

    def rows(self, part: Block, count: int) -> range:
        """The block's rows of the grid, without those that the bounds leave out."""
        first, last = part.number * count // part.of, (part.number + 1) * count // part.of
        inside = [i for i in (first, last - 1) if self.low <= self.lat0 + i * self.step <= self.high]
        if len(inside) == 2 or first >= last:
            return range(first, last)
        kept = [i for i in range(first, last) if self.low <= self.lat0 + i * self.step <= self.high]
        return range(kept[0], kept[-1] + 1) if kept else range(0)

    def read(self, part: Block):
        system, _ = opened(self.path)
        name = part.path.rsplit("/", 1)[-1].removesuffix(".npy")
        with system.open_input_file(part.path) as f:
            shape, by_column, kind, start = header(f)
            if len(shape) != 2:
                raise ValueError(f"{part.path}: {len(shape)} axes")
            height, width = shape
            rows = self.rows(part, height)
            if not len(rows) or not width:
                return
            piece = lambda at, n: np.frombuffer(f.read_at(n * kind.itemsize, start + at * kind.itemsize), kind)
            if by_column:
                a = np.stack([piece(j * height + rows[0], len(rows)) for j in range(width)], 1)
            else:
                a = piece(rows[0] * width, len(rows) * width).reshape(len(rows), width)
        step = max(1, 500_000 // width)
        for k in range(0, len(rows), step):
            v = a[k : k + step].astype(float).ravel()
            ilat = np.repeat(np.arange(rows[k], rows[k] + len(v) // width), width)
            cols = [pa.array([name] * len(v)), pa.array(ilat), pa.array(np.tile(np.arange(width), len(v) // width)), pa.array(self.lat0 + ilat * self.step), pa.array(v, mask=np.isnan(v))]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "ilat", "ilon", "lat", "v"])


class Rasters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def scan_rasters(spark: SparkSession, path: str, lat0: float, step: float, block: int = BLOCK) -> DataFrame:
    """(file, ilat, ilon, lat, v) of all rasters under ``path``; see the module's text."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Rasters)
    return spark.read.format("rasters").options(lat0=lat0, step=step, block=block).load(path)


def write_rasters(cells: DataFrame, path: str, name: str, rows: int, columns: int) -> None:
    """A file for each value of the column ``name``, from its cells (ilat, ilon, v); cells without a value are NaN.

    One raster is made by one task, as it is one file; a task that runs again writes the same file again.
    """

    def write(key, pdf):
        a = np.full((rows, columns), np.nan)
        a[pdf.ilat, pdf.ilon] = pdf.v
        out = io.BytesIO()
        np.save(out, a)
        system, at = opened(path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{key[0]}.npy") as f:
            f.write(out.getvalue())
        return pdf[[name]].head(0)

    cells.select(name, "ilat", "ilon", "v").groupBy(name).applyInPandas(write, f"{name} string").write.format("noop").mode("overwrite").save()
