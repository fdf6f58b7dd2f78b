"""Column profiles and the scores that suggest split keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import scores
from tidelake.operators.aggregates import spread_of, spread_of_few
from tidelake.operators.joins import null_safe_join
from tidelake.operators.ordered import ROWS_PER_BUCKET, dense_ranks
from tidelake.session import SMALL_ROWS, materialize, settled

ROWS_PER_SPLIT = 1_000_000
ROWS_PER_JOB = 100 * ROWS_PER_SPLIT
CONNECTIONS = 20

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Stored bytes of a value of a fixed-width type.
_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "boolean": 1}


def as_text(column: str, data_type: T.DataType) -> Column:
    """A value as text, fractions with six places so that every engine prints the same."""
    col = F.col(column)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.coalesce(col.try_cast("decimal(38,6)").cast("string"), col.cast("string"))
    return col.cast("string")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: distinct values, NULLs, average bytes, lowest and highest value.

    One pass with sketches for the distinct values. ``exact`` counts them in a
    second pass, which expands every row by the number of columns.
    """
    return profile_pass(df, columns, exact).drop("num_rows", "is_date")


def profile_pass(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """As ``column_profile``, with the table's rows and whether a column holds dates only, from the same pass."""
    types = {f.name: f.dataType for f in df.schema}
    columns = list(columns or df.columns)
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        ndv = F.lit(None).cast("bigint") if exact else F.approx_count_distinct(c)
        text = isinstance(types[c], (T.StringType, T.BinaryType))
        aggs += [
            ndv.alias(f"_ndv{i}"),
            F.count(c).alias(f"_cnt{i}"),
            (F.avg(F.octet_length(c)) if text else F.lit(_WIDTHS.get(types[c].simpleString(), 8))).cast("double").alias(f"_len{i}"),
            F.min(c).alias(f"_lo{i}"),
            F.max(c).alias(f"_hi{i}"),
            (_all_days(c, types[c]) if isinstance(types[c], _TEMPORAL) else F.lit(False)).alias(f"_day{i}"),
        ]
    one = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c].simpleString()).alias("data_type"),
            F.col(f"_ndv{i}").alias("num_distinct"),
            (F.col("_rows") - F.col(f"_cnt{i}")).alias("num_nulls"),
            (F.col("_rows") > F.col(f"_cnt{i}")).alias("is_null_ever"),
            F.col(f"_len{i}").alias("avg_col_len"),
            as_text(f"_lo{i}", types[c]).alias("low_value"),
            as_text(f"_hi{i}", types[c]).alias("high_value"),
            F.col("_rows").alias("num_rows"),
            F.col(f"_day{i}").alias("is_date"),
        )
        for i, c in enumerate(columns)
    ]
    profile = one.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    if not exact:
        return profile
    counts = exact_distinct(df, columns)
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"_ndv{i}").alias("_ndv")) for i, c in enumerate(columns)]
    ndv = counts.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return profile.join(ndv, "column_name").withColumn("num_distinct", F.col("_ndv")).drop("_ndv")


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the distinct values of every column, ``_ndv`` and its place; expands every row by the number of columns."""
    return df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"_ndv{i}") for i, c in enumerate(columns)])


def profile_from_stats(df: DataFrame, stats: DataFrame, num_rows: int) -> DataFrame:
    """As ``profile_pass``, from a catalogue's column statistics (COLUMN_NAME, NUM_DISTINCT, NUM_NULLS, AVG_COL_LEN, LOW_VALUE, HIGH_VALUE).

    Only columns with a time of day are read, as statistics do not say whether
    any value has one.
    """
    types = {f.name.upper(): f.dataType for f in df.schema}
    timed = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    days = {f.name.upper() for f in df.schema if isinstance(f.dataType, T.DateType)}
    if timed:
        found = df.agg(*[_all_days(c, types[c.upper()]).alias(c) for c in timed]).first()
        days |= {c.upper() for c in timed if found[c]}
    name = F.upper("COLUMN_NAME")
    known = {f.name.upper(): f.name for f in df.schema}
    pairs = [F.lit(x) for c in known for x in (c, known[c])]
    kinds = [F.lit(x) for c, t in types.items() for x in (c, t.simpleString())]
    return stats.filter(name.isin(list(known))).select(
        F.create_map(*pairs)[name].alias("column_name"), F.create_map(*kinds)[name].alias("data_type"),
        F.col("NUM_DISTINCT").cast("bigint").alias("num_distinct"), F.col("NUM_NULLS").cast("bigint").alias("num_nulls"),
        (F.col("NUM_NULLS") > 0).alias("is_null_ever"), F.col("AVG_COL_LEN").cast("double").alias("avg_col_len"),
        F.col("LOW_VALUE").alias("low_value"), F.col("HIGH_VALUE").alias("high_value"),
        F.lit(num_rows).cast("bigint").alias("num_rows"), (name.isin(list(days)) if days else F.lit(False)).alias("is_date"),
    )


def ranges_from_stats(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``partition_ranges``, from a catalogue's ranges per partition (COLUMN_NAME, PARTITION_NAME, LOW_VALUE, HIGH_VALUE)."""
    temporal = [f.name.upper() for f in df.schema if isinstance(f.dataType, _TEMPORAL)]
    name = F.upper("COLUMN_NAME")
    is_day = name.isin(temporal) if temporal else F.lit(False)

    def number(c: str) -> Column:
        day = F.unix_date(F.substring(c, 1, 10).try_cast("date")).cast("double")
        return F.when(is_day, day).otherwise(F.col(c).try_cast("double"))

    pairs = [F.lit(x) for c in columns for x in (c.upper(), c)]
    return stats.filter(name.isin([c.upper() for c in columns])).select(
        F.col("PARTITION_NAME").alias("partition"), F.create_map(*pairs)[name].alias("column_name"),
        F.col("LOW_VALUE").alias("lo_text"), F.col("HIGH_VALUE").alias("hi_text"),
        number("LOW_VALUE").alias("lo_num"), number("HIGH_VALUE").alias("hi_num"),
    )


def _all_days(column: str, kind: T.DataType) -> Column:
    """Whether no value of a temporal column has a time of day; false where there is no value."""
    return F.coalesce(F.bool_and(F.col(column).cast("date").cast(kind) == F.col(column)), F.lit(False))


def split_required(df: DataFrame, rows_per_split: int = ROWS_PER_SPLIT, rows_per_job: int = ROWS_PER_JOB) -> DataFrame:
    """Whether a table needs a split read, and whether it needs several jobs."""
    n = F.col("num_rows")
    split = F.floor(n / rows_per_split) > 1
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows",
        split.alias("split_required"),
        ((F.floor(n / rows_per_job) > 1) & split).alias("job_split_required"),
    )


def date_only_columns(df: DataFrame, landed: Sequence[str] = ()) -> DataFrame:
    """For every temporal column, whether no value has a time of day; one pass.

    ``landed`` names text columns that hold dates.
    """
    tests = {f.name: _all_days(f.name, f.dataType) for f in df.schema if isinstance(f.dataType, _TEMPORAL)}
    for c in landed:
        clock = F.substring(c, 12, 8)
        day = ((F.length(c) == 10) | (clock == "00:00:00")) & F.substring(c, 1, 10).try_cast("date").isNotNull()
        tests[c] = F.coalesce(F.bool_and(day), F.lit(False))
    cells = [F.struct(F.lit(c).alias("column_name"), t.alias("is_date")) for c, t in tests.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def load_pattern(counts: DataFrame, value: str, count: str, keys: Sequence[str] = ()) -> DataFrame:
    """How a column was loaded, from its value counts.

    ``is_chunked``: some count lies outside the trimmed mean plus or minus
    three scaled MADs. ``is_chrono``: the most frequent value is the smallest.
    """
    keys = list(keys)
    counts, small = settled(counts.filter(F.col(value).isNotNull()).select(*keys, value, count), "load-counts")
    spread = spread_of_few(counts, count, keys) if small else spread_of(counts, count, keys)
    top = counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col(count), F.col(value))).alias("high_freq"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.min(count).alias("_least"),
        F.max(count).alias("_most"),
    )
    if keys:
        both = null_safe_join(top, spread, keys, "inner")
    else:
        row = spread.first()
        both = top.select("*", *[F.lit(row[c]).alias(c) for c in ("trimmed_mean", "mad")])
    out = F.col("_most") > F.col("trimmed_mean") + 3 * F.col("mad")
    under = F.col("_least") < F.col("trimmed_mean") - 3 * F.col("mad")
    return both.select(
        *keys, "lo", "hi", "high_freq", "trimmed_mean", "mad",
        (out | under).alias("is_chunked"),
        (F.col("high_freq") == F.col("lo")).alias("is_chrono"),
    )


def split_scores(
    profile: DataFrame,
    num_rows: int,
    rows_per_split: int = ROWS_PER_SPLIT,
    rows_per_job: int | None = None,
    connections: int = CONNECTIONS,
    job_split: bool | None = None,
) -> DataFrame:
    """Split and job-split score of every column that is never NULL.

    ``profile`` holds column_name, num_distinct, num_nulls and the flags
    is_date, is_chunked, is_chrono, score_partition, drift and is_index.
    """
    rows_per_job = rows_per_job or 100 * rows_per_split
    if job_split is None:
        job_split = num_rows // rows_per_job > 1 and num_rows // rows_per_split > 1
    whole = Window.partitionBy(F.lit(0))  # one row per column of one table
    base = profile.filter("num_nulls = 0 AND num_distinct > 0")
    scored = base.select(
        "*",
        ((rows_per_job if job_split else num_rows) / F.col("num_distinct")).alias("rows_in_split"),
        scores.distinct_match(F.col("num_distinct"), connections).alias("dm_score"),
    )
    threshold = F.greatest(F.lit(0.1), F.percentile("dm_score", 0.875).over(whole))
    scored = scored.select(
        "*",
        ((F.col("rows_in_split") < rows_per_split) | (F.col("dm_score") > threshold)).alias("within_limit"),
        scores.date_score(F.col("is_date"), F.col("is_chunked"), F.col("is_chrono")).alias("date_score"),
    )
    return scored.select(
        "*",
        scores.split_score(
            F.col("rows_in_split"), F.col("within_limit"), rows_per_split,
            F.col("date_score"), F.col("drift"), F.col("dm_score"),
        ).alias("score_split"),
        scores.job_split_score(
            F.col("rows_in_split"), rows_per_job, F.col("date_score"),
            F.col("score_partition"), F.col("is_index"),
        ).alias("score_job_split"),
    )


def top_column(scored: DataFrame, score: Column | str, name: str = "column_name", keys: Sequence[str] = ()) -> DataFrame:
    """The column with the largest score per key, the first by name on a tie.

    The largest score comes from a hash aggregate; only rows that reach it are
    compared by name.
    """
    value = F.col(score) if isinstance(score, str) else score
    rated = scored.filter(value.isNotNull()).select(*keys, name, value.alias("score"))
    best = rated.groupBy(*keys).agg(F.max("score").alias("score"))
    if keys:
        return null_safe_join(rated, best, [*keys, "score"], "left_semi").groupBy(*keys, "score").agg(F.min(name).alias(name)).select(*keys, name, "score")
    return rated.join(best, "score", "left_semi").groupBy("score").agg(F.min(name).alias(name)).select(name, "score")


def suggest_keys(
    scored: DataFrame, split_bias: Sequence[str] = (), job_bias: Sequence[str] = ()
) -> DataFrame:
    """Split and job-split key; a column the caller names is lifted above all others."""
    whole = Window.partitionBy(F.lit(0))  # one row per column of one table

    def lifted(score: str, names: Sequence[str], least: float) -> Column:
        best = F.greatest(F.max(score).over(whole) + 0.0001, F.lit(least))
        named = F.upper("column_name").isin([n.upper() for n in names])
        return F.when(named, best).otherwise(F.col(score)) if names else F.col(score)

    rated = scored.select(
        "column_name",
        lifted("score_split", split_bias, 0.001).alias("split"),
        lifted("score_job_split", job_bias, 0.0001).alias("job_split"),
    )
    parts = F.explode(
        F.array(
            F.struct(F.lit("split").alias("role"), F.col("split").alias("score")),
            F.struct(F.lit("job_split").alias("role"), F.col("job_split").alias("score")),
        )
    )
    each = rated.select("column_name", parts.alias("p")).select("column_name", "p.*").filter("score IS NOT NULL")
    return each.groupBy("role").agg(F.min_by("column_name", F.struct(-F.col("score"), "column_name")).alias("column_name"), F.max("score").alias("score"))


def partition_ranges(df: DataFrame, partition: str | Column, columns: Sequence[str]) -> DataFrame:
    """Lowest and highest value of every column in every partition, as text with a number where there is one.

    Numbers count as they are and dates as day numbers.
    """
    types = {f.name: f.dataType for f in df.schema}
    of = F.col(partition) if isinstance(partition, str) else partition
    one = df.groupBy(of.cast("string").alias("partition")).agg(
        *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(columns)],
    )

    def number(name: str, t: T.DataType) -> Column:
        if isinstance(t, _TEMPORAL):
            return F.unix_date(F.col(name).cast("date")).cast("double")
        return F.col(name).try_cast("double")

    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_lo{i}").cast("string").alias("lo_text"),
            F.col(f"_hi{i}").cast("string").alias("hi_text"),
            number(f"_lo{i}", types[c]).alias("lo_num"),
            number(f"_hi{i}", types[c]).alias("hi_num"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select("partition", F.explode(F.array(*cells)).alias("s")).select("partition", "s.*")


def partition_drift(ranges: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """How far each column's range moves between partitions, from ``partition_ranges``.

    Text that does not all read as numbers is replaced by dense ranks. Ranges
    hold one row per column and partition, and a partition may be a key's
    value: so, unless they are few, ranks come from a range-partitioned list of the distinct texts,
    and medians from ranked values, without a task per column.
    """
    ranges, small = settled(ranges, "partition-ranges", min(SMALL_ROWS, rows_per_bucket))
    kinds = ranges.groupBy("column_name").agg(
        ((F.count("lo_text") == F.count("lo_num")) & (F.count("hi_text") == F.count("hi_num"))).alias("is_num"))
    kinds = {r["column_name"]: r["is_num"] for r in kinds.collect()}  # one row per column
    numeric = F.col("column_name").isin([c for c, n in kinds.items() if n])

    def cells(source: DataFrame, diff: Column, low: Column, high: Column) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("measure"), x.alias("x")) for m, x in (("diff", diff), ("low", low), ("high", high))])
        return source.select("column_name", F.explode(each).alias("c")).select("column_name", "c.*").filter("x IS NOT NULL")

    values = cells(ranges.filter(numeric), F.col("hi_num") - F.col("lo_num"), F.col("lo_num"), F.col("hi_num"))
    span = F.when(F.col("lo_text").isNotNull(), F.concat_ws(" - ", "lo_text", "hi_text"))
    texts = cells(ranges.filter(~numeric), span, F.col("lo_text"), F.col("hi_text")).withColumnRenamed("x", "text")
    keys = ["column_name", "measure"]
    if small:
        code = F.dense_rank().over(Window.partitionBy(*keys).orderBy("text")).cast("double")
        spread = spread_of_few(values.unionByName(texts.select(*keys, code.alias("x"))).coalesce(1), "x", keys)
    else:
        values = values.withColumn("n", F.lit(1).cast("bigint"))
        if not all(kinds.values()):
            counted = texts.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"))
            ranks = dense_ranks(counted, keys, "text", "code")
            values = values.unionByName(counted.join(ranks, [*keys, "text"]).select(*keys, F.col("code").cast("double").alias("x"), "n"))
        spread = spread_of(materialize(values, "drift-values"), "x", keys, count="n", rows_per_bucket=rows_per_bucket)

    def pick(measure: str, stat: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(stat)))

    return spread.groupBy("column_name").agg(
        scores.drift_score(
            pick("diff", "mad"), pick("diff", "median"),
            pick("low", "mad"), pick("low", "median"),
            pick("high", "mad"), pick("high", "median"),
        ).alias("drift")
    )


def split_viable(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Whether both halves of the key's range hold a row; one pass with given bounds, else two."""
    if low is None or high is None:
        low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.limit(0).agg(F.lit(False).alias("lower_half"), F.lit(False).alias("upper_half"), F.lit(False).alias("viable"))
    middle = low + (high - low) / 2
    col = F.col(key)
    return df.agg(
        F.coalesce(F.bool_or((col >= low) & (col <= F.lit(middle))), F.lit(False)).alias("lower_half"),
        F.coalesce(F.bool_or((col >= F.lit(middle)) & (col <= high)), F.lit(False)).alias("upper_half"),
    ).select("*", (F.col("lower_half") & F.col("upper_half")).alias("viable"))


def widen_range(ranges: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """Add ``wide_lo`` and ``wide_hi``: each bound moved out by one unit of its leading digit."""
    return ranges.select(
        "*",
        scores.widen(F.col(low), -1).alias("wide_lo"),
        scores.widen(F.col(high), 1).alias("wide_hi"),
    )
