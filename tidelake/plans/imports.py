"""From a source table to landing: analyse, choose a style, slice, read, write."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from decimal import Decimal
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import profile as P
from tidelake.operators import stored_profile as SP
from tidelake.plans import slicing as S
from tidelake.plans.pool import Job, run_jobs
from tidelake.session import materialize, settled
from tidelake.sources import jdbc
from tidelake.sources.sinks import path_exists

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_SPLITTABLE = (*_WHOLE, "date", "timestamp", "timestamp_ntz", "float", "double", "decimal")
# more values of a point key than this are read as ranges of values
MOST_POINTS = 200


def _base(kind: str) -> str:
    return kind.partition("(")[0]


@dataclass(frozen=True)
class Analysis:
    """What profiling found: scores per column and the keys they suggest."""

    num_rows: int
    rows_per_split: int
    rows_per_job: int
    connections: int
    is_partitioned: bool
    scored: DataFrame
    split_key: str | None
    job_key: str | None


@dataclass(frozen=True)
class ImportPlan:
    """How to read a table: one row of ``import_style`` with the ranges and slices."""

    table: str
    style: str
    split_key: str | None = None
    low: object = None
    high: object = None
    splits: int = 1
    connections: int = 20
    jobs: tuple[S.Slice, ...] = ()
    state: str = "COMPLETE"


def analyse(
    df: DataFrame,
    partition: str | None = None,
    partition_by: Column | None = None,
    subpartition: str | None = None,
    index_columns: Sequence[str] = (),
    rows_per_split: int = P.ROWS_PER_SPLIT,
    rows_per_job: int | None = None,
    connections: int = P.CONNECTIONS,
    split_bias: Sequence[str] = (),
    job_bias: Sequence[str] = (),
    exact: bool = False,
    column_stats: DataFrame | None = None,
    stored_rows: int | None = None,
    value_counts: DataFrame | None = None,
    partition_stats: DataFrame | None = None,
    profile: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> Analysis:
    """Profile a table and score its columns as split and job-split keys.

    ``partition`` is the partition key column and ``partition_by`` the
    partition of a row, by default the key's value. Columns that are ever NULL
    are left out. Without a partition key every drift score is 0.

    What a catalogue has stored is not scanned again: ``column_stats`` with
    ``stored_rows`` stands for the profile, ``value_counts`` (column_name, day,
    n) for the date columns' counts, and ``partition_stats`` (column_name,
    partition, LOW_VALUE, HIGH_VALUE as text) for the ranges per partition.
    ``profile`` and ``ranges`` are either of them as the library keeps it itself
    (``stored_profile.merged_profile`` and ``stored_ranges``).
    """
    rows_per_job = rows_per_job or 100 * rows_per_split
    spark = df.sparkSession
    if profile is None and (column_stats is None or stored_rows is None) and partition and ranges is None and partition_stats is None:
        # one pass for the profile and the ranges of partitions
        of = F.col(partition) if partition_by is None else partition_by
        kept, _ = settled(SP.profile_partitions(df, of), "profile-parts")
        profile, ranges = SP.merged_profile(kept), SP.stored_ranges(kept, df.columns)
    elif profile is None and (column_stats is None or stored_rows is None):
        profile = P.profile_pass(df)
    elif profile is None:
        profile, exact = P.profile_from_stats(df, column_stats, stored_rows), False
    columns = {r["column_name"]: r.asDict() for r in profile.collect()}  # one row per column
    if exact:
        distinct = P.exact_distinct(df, list(columns)).first()
        for i, c in enumerate(columns):
            columns[c]["num_distinct"] = distinct[f"_ndv{i}"]
    num_rows = next((r["num_rows"] for r in columns.values()), 0)
    dated = [c for c, r in columns.items() if r["is_date"]]
    pattern = {}
    if dated:
        cells = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("date").alias("day")) for c in dated])
        )
        counts = value_counts
        if counts is None:
            counts = df.select(cells.alias("c")).select("c.*").groupBy("column_name", "day").agg(F.count(F.lit(1)).alias("n"))
        pattern = {r["column_name"]: r for r in P.load_pattern(counts, "day", "n", ["column_name"]).collect()}
    drift = {}
    if partition:
        full = [c for c, r in columns.items() if r["num_nulls"] == 0]
        if ranges is not None:
            ranges = ranges.filter(F.col("column_name").isin(full))
        elif partition_stats is None:
            ranges = P.partition_ranges(df, partition if partition_by is None else partition_by, full)
        else:
            ranges = P.ranges_from_stats(df, partition_stats, full)
        drift = {r["column_name"]: r["drift"] for r in P.partition_drift(ranges).collect()}

    def weight(name: str) -> float:
        if partition and name.upper() == partition.upper():
            return 1.0
        return 0.3 if subpartition and name.upper() == subpartition.upper() else 0.0

    indexed = {c.upper() for c in index_columns}
    flagged = spark.createDataFrame(
        [(c, r["data_type"], r["num_distinct"], r["num_nulls"], r["is_date"],
          bool(c in pattern and pattern[c]["is_chunked"]), bool(c in pattern and pattern[c]["is_chrono"]),
          drift.get(c) or 0.0, weight(c), c.upper() in indexed) for c, r in columns.items()],
        "column_name string, data_type string, num_distinct bigint, num_nulls bigint, is_date boolean, is_chunked boolean, "
        "is_chrono boolean, drift double, score_partition double, is_index boolean",
    ).coalesce(1)
    scored = materialize(P.split_scores(flagged, num_rows, rows_per_split, rows_per_job, connections), "scores").coalesce(1)
    keys = {r["role"]: r["column_name"] for r in P.suggest_keys(scored, split_bias, job_bias).collect()}
    return Analysis(
        num_rows, rows_per_split, rows_per_job, connections, partition is not None or subpartition is not None,
        scored, keys.get("split"), keys.get("job_split"),
    )


def main_range(df: DataFrame, key: str, numeric: bool) -> tuple[object, object, str]:
    """The range to split a key over, and how sure it is.

    The exact range if both its halves hold rows, else, for numbers, the
    widened range if its halves do; otherwise the exact range, ``PARTIAL``.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None, None, "UNKNOWN"
    if P.split_viable(df, key, low, high).first()["viable"]:
        return low, high, "COMPLETE"
    if numeric:
        low, high = math.floor(low), math.ceil(high)
        wide = P.widen_range(df.sparkSession.range(1).select(F.lit(low).alias("lo"), F.lit(high).alias("hi"))).first()
        if P.split_viable(df, key, wide["wide_lo"], wide["wide_hi"]).first()["viable"]:
            return int(wide["wide_lo"]), int(wide["wide_hi"]), "COMPLETE"
    return low, high, "PARTIAL"


def plan_import(
    df: DataFrame,
    table: str,
    found: Analysis,
    is_view: bool = False,
    force_pointable: bool = False,
    strict_ranges: DataFrame | None = None,
    days_per_slice: int | None = None,
) -> ImportPlan:
    """Choose a style and cut the slices of a table.

    ``strict_ranges`` (columns ``lo`` and ``hi``) restricts a range style to
    the given days, in slices of about ``days_per_slice``.
    """
    if found.split_key is None:
        return ImportPlan(table, "PLAIN", connections=found.connections)
    rows = {r["column_name"]: r for r in found.scored.collect()}  # one row per column
    split, job = rows[found.split_key], rows[found.job_key]
    kind = job["data_type"]
    described = df.sparkSession.range(1).select(
        F.lit(found.num_rows).cast("bigint").alias("num_rows"),
        F.lit(found.rows_per_split).cast("bigint").alias("rows_per_split"),
        F.lit(found.rows_per_job).cast("bigint").alias("rows_per_job"),
        F.lit(found.connections).cast("bigint").alias("connections"),
        F.lit(found.split_key).alias("split_key"),
        F.lit(found.job_key).alias("job_key"),
        F.lit(job["num_distinct"]).cast("bigint").alias("job_key_ndv"),
        F.lit("DATE" if kind == "date" or kind.startswith("timestamp") else "OTHER").alias("job_key_type"),
        F.lit(split["drift"]).cast("double").alias("drift"),
        F.lit(found.is_partitioned).alias("is_partitioned"),
        F.lit(is_view).alias("is_view"),
        F.lit(force_pointable).alias("force_pointable"),
    )
    chosen = S.import_style(described).first()
    plan = ImportPlan(table, chosen["style"], connections=found.connections)
    if plan.style == "PLAIN":
        return plan
    if _base(split["data_type"]) in _SPLITTABLE:
        numeric = "date" not in split["data_type"] and "timestamp" not in split["data_type"]
        low, high, state = main_range(df, found.split_key, numeric)
        if low is not None and low < high:
            plan = replace(
                plan, split_key=found.split_key, low=low, high=high, splits=chosen["splits"], state=state
            )
    if plan.style == "SPLIT":
        return plan
    if plan.style == "POINT+FIXED":
        points = materialize(S.point_slices(df, found.job_key), "points")
        if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
            ranges = S.to_slices(S.point_ranges(points, int(chosen["njobs"])), found.job_key, open_ends=True)
            return replace(plan, jobs=tuple(ranges))
        return replace(plan, jobs=tuple(S.to_slices(points, found.job_key)))
    if plan.style.startswith("RANGE"):
        key = F.col(found.job_key)
        key = key.cast("date") if rows[found.job_key]["is_date"] or kind.startswith("timestamp") else key
        if strict_ranges is not None:
            cut = S.strict_slices(strict_ranges, days_per_slice or 10)
            return replace(plan, jobs=tuple(S.to_slices(cut, found.job_key, null_slice=False)))
        low, high = F.min(key), F.max(key)
        if _base(kind) in ("float", "double", "decimal"):
            low, high = F.floor(low).try_cast("bigint"), F.ceil(high).try_cast("bigint")
        ranges = df.agg(low.alias("lo"), high.alias("hi"))
        if ranges.schema["lo"].dataType.simpleString() in ("date", *_WHOLE):
            cut = S.range_slices(ranges, int(chosen["njobs"]))
            return replace(plan, jobs=tuple(S.to_slices(cut, found.job_key, open_ends=True)))
    return plan


def _plain(value: object) -> object:
    """A value JSON can hold, with its type where JSON has none."""
    if isinstance(value, dt.datetime):
        return {"datetime": value.isoformat()}
    if isinstance(value, dt.date):
        return {"date": value.isoformat()}
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    return value


def _typed(value: object) -> object:
    if not isinstance(value, dict):
        return value
    ((kind, text),) = value.items()
    return {"datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": Decimal}[kind](text)


def plan_text(plan: ImportPlan) -> str:
    held = {f.name: _plain(getattr(plan, f.name)) for f in fields(plan) if f.name != "jobs"}
    held["jobs"] = [{f.name: _plain(getattr(j, f.name)) for f in fields(j)} for j in plan.jobs]
    return json.dumps(held, sort_keys=True)


def plan_from_text(text: str) -> ImportPlan:
    held = json.loads(text)
    jobs = tuple(S.Slice(**{k: _typed(v) for k, v in j.items()}) for j in held.pop("jobs"))
    return ImportPlan(**{k: _typed(v) for k, v in held.items()}, jobs=jobs)


def stored_plan(spark: SparkSession, path: str) -> ImportPlan | None:
    """The plan an import into ``path`` was started with, to start it anew."""
    if not path_exists(spark, f"{path}/_plan/_SUCCESS"):
        return None
    return plan_from_text(spark.read.text(f"{path}/_plan").first()[0])


def run_import(
    spark: SparkSession, url: str, plan: ImportPlan, path: str, properties: Mapping[str, str] | None = None
) -> int:
    """Read a table by its plan into ``path``, one folder per job, and return the jobs run.

    The plan is written beside the jobs. An import that stopped is started anew
    with the same plan (``stored_plan``) and runs the jobs that were not
    committed; another plan is refused, since its slices would not fit. The
    first and last range are open and so are the outer splits, so rows that
    came in past the planned range are read; an import is no snapshot of a
    source that changes meanwhile. Slices without a split column are read side
    by side in one job, as many as there are connections; jobs with one run
    side by side as long as their splits together fit the connections.
    """
    before = stored_plan(spark, path)
    if before is None:
        spark.createDataFrame([(plan_text(plan),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_plan")
    elif before != plan:
        raise ValueError(f"{path} was begun with another plan; take stored_plan() or a new folder")
    jobs: Sequence[S.Slice | None] = plan.jobs or (None,)
    todo = [(n, j) for n, j in enumerate(jobs) if not path_exists(spark, f"{path}/job={n}/_SUCCESS")]
    if plan.split_key is None and len(jobs) > 1:
        for start in range(0, len(todo), plan.connections):
            part = todo[start : start + plan.connections]
            read = jdbc.read_predicates(spark, url, plan.table, [j for _, j in part], connections=plan.connections, properties=properties)
            numbered = read.withColumn("job", _job_of(part))
            numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)
            for n, _ in part:  # an empty slice leaves no folder
                spark.createDataFrame([], read.schema).write.mode("append").parquet(f"{path}/job={n}")
        return len(todo)
    run_jobs(spark, [Job(_splits_of(plan, j), partial(_run_job, spark, url, plan, f"{path}/job={n}", j, properties)) for n, j in todo], plan.connections)
    return len(todo)


def _splits_of(plan: ImportPlan, job: S.Slice | None) -> int:
    """The connections a job opens at most."""
    return 1 if plan.split_key is None or (job is not None and job.no_key) else plan.splits


def _run_job(spark: SparkSession, url: str, plan: ImportPlan, path: str, job: S.Slice | None, properties: Mapping[str, str] | None) -> None:
    source = f"SELECT * FROM {plan.table}"
    where = job.sql() if job is not None else None
    low, high = plan.low, plan.high
    if plan.style == "RANGE+SAME_RANGE" and job is not None and not job.no_key:
        low, high = plan.low if job.low is None else job.low, plan.high if job.high is None else job.high
    if _splits_of(plan, job) == 1:
        rows = jdbc.read_query(spark, url, source, where, properties=properties)
    else:
        rows = jdbc.read_query(spark, url, source, where, plan.split_key, low, high, plan.splits, plan.connections, properties)
    rows.write.mode("overwrite").parquet(path)


def _job_of(jobs: Sequence[tuple[int, S.Slice]]) -> Column:
    """The number of the slice a row belongs to."""
    out = F.lit(None).cast("int")
    for number, job in reversed(jobs):
        out = F.when(job.column(), F.lit(number)).otherwise(out)
    return out


def read_imported(spark: SparkSession, path: str) -> DataFrame:
    """The landed rows of all jobs, without the job number."""
    return spark.read.parquet(path).drop("job")
