"""KPI CSV sources.

S1 reads the per-UE metric files of a directory tree
``{base}/{sched}/{tr}/exp*/bs*/slices_bs*/*_metrics.csv`` through the data source of
``kpi_source``, which derives the dimensions from each file's path.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .. import params as P
from ..functions.columns import nan_to_null
from ..session import apply_required_conf
from .kpi_source import DIMENSIONS, KpiTree

# Types of the metric files' columns by header name; any other column stays a string.
RAW_CSV_TYPES = {
    "Timestamp": "long", "tx_brate downlink [Mbps]": "double", "sum_requested_prbs": "int",
    "sum_granted_prbs": "int", "tx_errors downlink (%)": "double", "rx_errors uplink (%)": "double",
    "dl_cqi": "int", "num_ues": "int", "slice_id": "int",
}
LOG = logging.getLogger(__name__)

SCHED_POLICIES = ["sched0", "sched1", "sched2"]
TRAINING_CONFIGS = [f"tr{i}" for i in range(28)]


def rename_raw(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Raw CSV names -> library names (plus optional custom renames, S2); NaN -> null.

    A ``NaN`` field means "missing" in the source data, while Spark reads it as a NaN double
    that sorts above every number; floating columns therefore get ``nanvl(x, null)``.
    """
    m = dict(P.RAW_COLUMN_NAMES)
    m.update(extra or {})
    df = df.withColumnsRenamed({k: v for k, v in m.items() if k in df.columns})
    return df.withColumns({f.name: nan_to_null(F.col(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, (DoubleType, FloatType))})


@dataclass(frozen=True)
class Layout:
    """Where the files of a tree lie: a glob with ``{scheds}`` and ``{configs}``, and for each
    dimension the pattern of the path that holds it (first group)."""

    glob: str = "{scheds}/{configs}/exp*/bs*/slices_bs*/*_metrics.csv"
    exp_id: str = r"/exp(\d+)/"
    bs_id: str = r"/bs(\d+)/slices_bs"
    imsi: str = r"/([^/]+)_metrics\.csv$"
    sched_policy: str = r"/(sched[^/]+)/tr[^/]+/exp"
    training_config: str = r"/sched[^/]+/(tr[^/]+)/exp"


# the same files as a partitioned table, as Spark writes it
PARTITIONED = Layout("sched_policy={scheds}/training_config={configs}/*.csv",
                     r"/exp_id=(\d+)/", r"/bs_id=(\d+)/", r"/([^/]+)\.csv$", r"/sched_policy=([^/]+)/",
                     r"/training_config=([^/]+)/")


def _typed(name: str):
    c, kind = F.col(f"`{name}`"), RAW_CSV_TYPES.get(name)
    if kind in ("int", "long"):  # whole numbers may be written as 3.0
        return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast(kind))
    return c.try_cast(kind) if kind else c


def _tree(spark: SparkSession, root: str, scheds, configs, layout: Layout, tasks: int | None, only: dict | None):
    """A reader of the tree under ``root``."""
    spark.dataSource.register(KpiTree)
    tasks = tasks or 3 * spark.sparkContext.defaultParallelism
    first, second, rest = layout.glob.split("/", 2)
    return spark.read.format("kpi_tree").options(
        path=root, scheds=json.dumps(list(scheds)), configs=json.dumps(list(configs)), levels=f"{first}/{second}",
        files=rest, tasks=str(tasks), only=json.dumps(only or {}), **{d: getattr(layout, d) for d in DIMENSIONS})


def kpi_headers(spark: SparkSession, base: str, scheds=SCHED_POLICIES, configs=TRAINING_CONFIGS,
                layout: Layout = Layout(), tasks: int | None = None, only: dict[str, list] | None = None) -> DataFrame:
    """``path, names`` of every metric file under ``base`` (or those that ``only`` asks for): its columns, null for a file that cannot
    be read or has no header line.  Only headers are read."""
    return _tree(spark, base, scheds, configs, layout, tasks, only).load()


def scan_kpi_tree(spark: SparkSession, base: str, scheds=SCHED_POLICIES, configs=TRAINING_CONFIGS,
                  layout: Layout = Layout(), columns: list[str] | None = None, tasks: int | None = None,
                  only: dict[str, list] | None = None) -> DataFrame:
    """All metric files under ``base/rome_static_medium`` or ``base`` (whichever has them),
    columns found by header name.

    Each read task takes a share of a (policy, configuration) directory, ``tasks`` in all (three a core
    where not given, one a directory at least), and every file's columns may come in any order; a column that a file lacks is null there.  Known
    columns get their types (a value that does not parse is null), others stay strings.  Without
    ``columns`` one job over the first lines finds the names; the driver gets the different names and
    two counts.  Files that cannot be read are skipped and their number is logged.  ``only`` gives the
    wanted values of dimensions (``{"bs_id": [8]}``); files with others are not opened.
    """
    apply_required_conf(spark)
    for root in (f"{base}/rome_static_medium", base):
        heads = kpi_headers(spark, root, scheds, configs, layout, tasks, only)
        if columns is None:
            found = heads.agg(F.count(F.lit(1)).alias("files"), F.count("names").alias("good"),
                              F.min(F.when(F.col("names").isNull(), F.col("path"))).alias("lost"),
                              F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names")).first()
            if found["files"] == 0:
                continue
            if found["lost"]:
                LOG.warning("%d of %d metric files have no readable header and are left out, e.g. %s",
                            found["files"] - found["good"], found["files"], found["lost"])
            if not found["good"]:
                raise FileNotFoundError(f"no readable KPI metric file under {base}")
            names = found["names"]
        else:
            if heads.isEmpty():
                continue
            names = list(columns)
        break
    else:
        raise FileNotFoundError(f"no KPI metric files under {base}")
    # the slice is optional: F3 fills it
    names += [n for n in RAW_CSV_TYPES if n not in names and n != "slice_id"]
    rows = _tree(spark, root, scheds, configs, layout, tasks, only).option("columns", json.dumps(names)).load()
    return rename_raw(rows.select(*[_typed(n).alias(n) for n in names], *DIMENSIONS))


def read_custom_csv(spark: SparkSession, path: str, renames: dict[str, str] | None = None,
                    schema: str | None = None) -> DataFrame:
    """A single custom CSV with column renames (default ``ue_count -> num_ues``,
    ``slice_name -> slice_id``), then the library's names for the raw KPI columns."""
    renames = renames if renames is not None else {"ue_count": "num_ues", "slice_name": "slice_id"}
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return rename_raw(r.csv(path), renames)
