"""The KPI metric tree as a Spark data source.

``spark.read.format("kpi_tree")`` over a tree of metric files: the driver lists directories of the
first two levels only (policies and configurations) and deals them into about ``tasks`` read tasks.  A
task lists its directory, takes its share of the files, reads each file's own header and then its
rows, so rows are read once and no work or memory of the driver grows with the files.  The
dimensions come from the paths, and the values asked for are tested before a file is opened.

The values are an option of the source and not Spark's filter push-down to Python sources: Spark
4.1 keeps what one query pushed for every later query of the same DataFrame, which then lose rows.
"""

from __future__ import annotations

import csv
import io
import json
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pa_csv
from pyarrow import fs as pa_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG = logging.getLogger(__name__)

DIMENSIONS = ["exp_id", "bs_id", "imsi", "sched_policy", "training_config"]
NUMBERS = ("exp_id", "bs_id")           # 1 where the path does not tell
REQUIRED = "Timestamp"                  # a header names at least this column
MAX_HEADER = 1 << 20                    # bytes; no header of a metric file is longer
BLOCK = 4 << 20                         # bytes of a file that a task holds at once


def file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI (``file:/x`` too) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return pa_fs.FileSystem.from_uri(path)
    return pa_fs.LocalFileSystem(), path


def children(fs: pa_fs.FileSystem, base: str, pattern: str) -> list[str]:
    infos = fs.get_file_info(pa_fs.FileSelector(base, allow_not_found=True))
    return sorted(i.path for i in infos if i.type == pa_fs.FileType.Directory and fnmatchcase(i.base_name, pattern))


def header_names(f) -> list[str] | None:
    """Column names of an opened file's first line, None if it is not a header."""
    line = f.read(MAX_HEADER).split(b"\n", 1)[0]
    text = line.decode("utf-8-sig", "replace").rstrip("\r")
    if REQUIRED not in text:
        return None
    names = [n.strip().strip('"').strip() for n in next(csv.reader([text]))]
    return [n or f"_c{i}" for i, n in enumerate(names)]


@dataclass
class Share(InputPartition):
    """One task's share of the files below a directory."""

    directory: str
    slot: int = 0
    slots: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str], headers: bool):
        self.base, self.tasks = options["path"], int(options["tasks"])
        self.scheds, self.configs = json.loads(options["scheds"]), json.loads(options["configs"])
        self.rest = options["files"].split("/")          # patterns below the second level
        self.levels = options["levels"].split("/")       # of the first two, with {scheds}, {configs}
        self.patterns = {d: options[d] for d in DIMENSIONS}
        self.wanted = {d: {str(v) for v in values} for d, values in json.loads(options["only"]).items()}
        self.names, self.headers = names, headers

    def partitions(self):
        fs, base = file_system(self.base)
        found = []
        for sched in self.scheds:
            for top in children(fs, base, self.levels[0].replace("{scheds}", sched)):
                for config in self.configs:
                    found += children(fs, top, self.levels[1].replace("{configs}", config))
        found = sorted(set(found))
        slots = -(-self.tasks // max(1, len(found)))
        return [Share(d, i, slots) for d in found for i in range(slots)] or [Share("")]

    def dimensions(self, path: str) -> dict:
        out = {}
        for name, pattern in self.patterns.items():
            m = re.search(pattern, path)
            out[name] = m.group(1) if m else ("1" if name in NUMBERS else "")
            if name in NUMBERS:
                out[name] = int(out[name])
        return out

    def files(self, share: Share) -> Iterator[tuple[pa_fs.FileSystem, str, dict]]:
        """The share's files with the dimensions asked for, none of them opened yet."""
        if not share.directory:
            return
        fs, _ = file_system(self.base)
        for i in fs.get_file_info(pa_fs.FileSelector(share.directory, recursive=True)):
            below = i.path[len(share.directory):].strip("/").split("/")
            if (i.type != pa_fs.FileType.File or len(below) != len(self.rest)
                    or not all(map(fnmatchcase, below, self.rest))
                    or zlib.crc32("/".join(below).encode()) % share.slots != share.slot):
                continue
            dims = self.dimensions(i.path)
            if all(str(dims[name]) in values for name, values in self.wanted.items()):
                yield fs, i.path, dims

    def read(self, share: Share):
        for fs, path, dims in self.files(share):
            try:
                with fs.open_input_stream(path) as f:
                    names = header_names(f)
                if self.headers:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([names], pa.list_(pa.string()))],
                                                     ["path", "names"])
                elif names:
                    with fs.open_input_stream(path) as f:
                        yield from self.rows(f, names, dims)
            except (OSError, pa.ArrowInvalid) as e:
                LOG.warning("%s cannot be read and is left out: %s", path, e)
                if self.headers:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.list_(pa.string()))],
                                                     ["path", "names"])

    def rows(self, f, names: list[str], dims: dict) -> Iterator[pa.RecordBatch]:
        """A file's rows block by block, all fields as trimmed strings, empty ones null.  A row with
        too few fields has nulls at its end, surplus fields are dropped."""
        place = {}
        for i, n in enumerate(names):
            place.setdefault(n, i)  # of columns with one name the first counts
        ragged: list[str] = []

        def keep(row):
            ragged.append(row.text)
            return "skip"

        plain = [str(i) for i in range(len(names))]
        reader = pa_csv.open_csv(
            f, pa_csv.ReadOptions(use_threads=False, block_size=BLOCK, column_names=plain, skip_rows=1),
            pa_csv.ParseOptions(invalid_row_handler=keep),
            pa_csv.ConvertOptions(column_types={c: pa.string() for c in plain}, check_utf8=False))
        for batch in reader:
            yield self.shaped(batch.columns, place, batch.num_rows, dims)
        if ragged:
            rows = list(csv.reader(io.StringIO("\n".join(ragged))))
            cols = [pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(len(names))]
            yield self.shaped(cols, place, len(rows), dims)

    def shaped(self, columns, place: dict, n: int, dims: dict) -> pa.RecordBatch:
        out = []
        for name in self.names:
            if name in place:
                c = pc.utf8_trim_whitespace(columns[place[name]])
                out.append(pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c))
            else:
                out.append(pa.nulls(n, pa.string()))
        for d in DIMENSIONS:
            out.append(pa.array([dims[d]] * n, pa.int32() if d in NUMBERS else pa.string()))
        return pa.RecordBatch.from_arrays(out, self.names + DIMENSIONS)


class KpiTree(DataSource):
    """``columns`` (JSON list): the columns to give, as strings, next to the dimensions; a file
    without one has nulls.  Without ``columns``: each file's path and header names."""

    @classmethod
    def name(cls):
        return "kpi_tree"

    def schema(self):
        if "columns" not in self.options:
            return "path string, names array<string>"
        names = ", ".join(f"`{n}` string" for n in json.loads(self.options["columns"]))
        return f"{names}, " + ", ".join(f"{d} {'int' if d in NUMBERS else 'string'}" for d in DIMENSIONS)

    def reader(self, schema):
        columns = self.options.get("columns")
        return TreeReader(dict(self.options), json.loads(columns or "[]"), columns is None)
