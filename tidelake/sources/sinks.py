"""Landing files and tables: append, sample, text, register, insert, drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"
SMALL_TABLE_ROWS = 100_000
BYTES_PER_FILE = 64 << 20


def land_append(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Append Parquet to a landing folder; ``compression`` may be ``none``."""
    df.write.mode("append").option("compression", compression).parquet(path)


def land_sample(df: DataFrame, path: str, rows: int, compression: str = "snappy") -> None:
    """Replace a folder by a limited import of ``rows`` rows."""
    df.limit(rows).write.mode("overwrite").option("compression", compression).parquet(path)


def _text_options(null_mark: str) -> dict[str, str]:
    """Quotes are doubled, blanks kept, and empty text is written quoted to tell it from NULL."""
    return {
        "nullValue": null_mark,
        "escape": '"',
        "lineSep": "\n",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    }


def write_text(df: DataFrame, path: str, null_mark: str = NULL_MARK, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Delimited text in which NULL is a mark of its own.

    Files are kept to about ``bytes_per_file``, because a file whose values span
    lines is read whole by one task. The mean row, from one pass, gives the
    rows of a file.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    width = F.lit(24 * len(df.columns))
    for c in texts:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    mean = df.agg(F.avg(width)).first()[0] or 1.0
    options = {**_text_options(null_mark), "maxRecordsPerFile": str(max(1, int(bytes_per_file / mean)))}
    df.write.mode("overwrite").options(**options).csv(path)


def read_text(spark: SparkSession, path: str, schema: T.StructType, null_mark: str = NULL_MARK) -> DataFrame:
    """Read ``write_text`` files; values may span lines, so each file is one task."""
    return (
        spark.read.schema(schema)
        .options(**_text_options(null_mark))
        .option("multiLine", True)
        .option("maxCharsPerColumn", -1)
        .csv(path)
    )


def write_stats_csv(stats: DataFrame, folder: str, name: str) -> None:
    """Statistics of one table, a row per column, as the file ``name.csv`` of a folder."""
    spark = stats.sparkSession
    written = f"{folder}/_{name}"
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(written)
    fs, _ = _path(spark, folder)
    part = next(f.getPath() for f in fs.listStatus(_path(spark, written)[1]) if f.getPath().getName().endswith(".csv"))
    fs.delete(_path(spark, f"{folder}/{name}.csv")[1], False)
    if not fs.rename(part, _path(spark, f"{folder}/{name}.csv")[1]):
        raise OSError(f"could not write {folder}/{name}.csv")
    delete_path(spark, written)


def quoted(name: str) -> str:
    """A dotted name with every part quoted."""
    return ".".join(f"`{p.replace('`', '``')}`" for p in name.split("."))


def create_database(spark: SparkSession, db: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(db)} LOCATION '{location}'")


def register_external(spark: SparkSession, table: str, path: str, probe: int = 20) -> DataFrame:
    """Put an external table over landed Parquet, schema from the files, and probe it."""
    spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    spark.sql(f"CREATE TABLE {quoted(table)} USING parquet LOCATION '{path}'")
    out = spark.table(table)
    out.limit(probe).collect()
    return out


def create_gold(spark: SparkSession, table: str, schema: T.StructType, path: str) -> None:
    """A typed external Parquet table with the given columns, dropped first if it exists."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    spark.sql(f"CREATE TABLE {quoted(table)} ({columns}) USING parquet LOCATION '{path}'")


def insert_overwrite(df: DataFrame, table: str) -> None:
    """Replace the content of a table; columns are matched by name."""
    _insert(df, table, overwrite=True)


def insert_append(df: DataFrame, table: str) -> None:
    """Add rows to a table; columns are matched by name."""
    _insert(df, table, overwrite=False)


def _insert(df: DataFrame, table: str, overwrite: bool) -> None:
    ordered = df.select(*[F.col(f"`{c}`") for c in df.sparkSession.table(table).columns])
    ordered.write.insertInto(table, overwrite=overwrite)


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def guarded_drop(spark: SparkSession, table: str, below: int = SMALL_TABLE_ROWS) -> bool:
    """Drop a table and its files only when it has fewer than ``below`` rows."""
    if spark.table(table).limit(below).count() >= below:
        return False
    location = table_location(spark, table)
    spark.sql(f"DROP TABLE {quoted(table)}")
    delete_path(spark, location)
    return True


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def recover_folder(spark: SparkSession, path: str) -> None:
    """Put the old folder back where a replacement stopped between its two moves."""
    old = f"{path}.old"
    if not path_exists(spark, path) and path_exists(spark, old):
        fs, target = _path(spark, path)
        fs.rename(_path(spark, old)[1], target)


def replace_folder(df: DataFrame, path: str) -> None:
    """Replace a Parquet folder that ``df`` may itself read.

    The rows go to a folder beside the target first. The old folder is moved
    aside, not deleted, until the new one is in place; ``recover_folder``
    undoes a replacement that stopped in between.
    """
    spark = df.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    recover_folder(spark, path)
    df.write.mode("overwrite").parquet(staged)
    fs, target = _path(spark, path)
    delete_path(spark, old)
    if fs.exists(target):
        fs.rename(target, _path(spark, old)[1])
    if not fs.rename(_path(spark, staged)[1], target):
        raise OSError(f"could not move {staged} to {path}")
    delete_path(spark, old)
