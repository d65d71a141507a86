"""Bar sources: one Parquet file per symbol, or any table of ticks."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import finite

PRICES = ["open", "high", "low", "close"]


class MissingBarsError(FileNotFoundError):
    """Raised when daily symbols have no minute file."""


def symbol_files(spark: SparkSession, directory: str, symbols: DataFrame | None = None) -> DataFrame:
    """(symbol, path) of the <SYMBOL>.parquet files of a folder, from their names only; of the given symbols alone if any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(directory).select(
        F.regexp_extract("path", r"([^/]*)\.parquet$", 1).alias("symbol"), "path")
    return files if symbols is None else files.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def _opened(path: str):
    """File system and path in it; the name is kept out of the URI, where # and ? would end it."""
    from pyarrow import fs

    folder, _, name = path.rpartition("/")
    if "://" not in folder or folder.startswith("file:"):
        return fs.LocalFileSystem(), f"{folder.removeprefix('file:')}/{name}"
    system, base = fs.FileSystem.from_uri(folder)
    return system, f"{base}/{name}"


def _layouts(files: DataFrame, columns: list[str]) -> list[list[str]]:
    """Paths grouped by the names and types that their footers give the columns.

    Footers are read in tasks.  The driver sees one path a file, as it does when Spark lists a folder.
    """
    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for batch in batches:
            paths, layouts = batch.column(0).to_pylist(), []
            for path in paths:
                system, at = _opened(path)
                schema = parquet.read_schema(at, filesystem=system)
                found = {f.name.lower(): f"{f.name} {f.type}" for f in schema if f.name.lower() in columns}
                if lost := [c for c in columns if c not in found]:
                    raise ValueError(f"{path} lacks {', '.join(lost)}")
                layouts.append(", ".join(found[c] for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(layouts, pa.string())],
                                             names=["path", "layout"])

    found = files.select("path").mapInArrow(footers, "path string, layout string")
    groups = found.groupBy("layout").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [r.paths for r in groups.orderBy("layout").collect()]


def _file_symbol() -> Column:
    """The symbol of a row's file; file metadata carries names percent-encoded, with + as itself."""
    name = F.regexp_replace("_metadata.file_name", r"\.parquet$", "")
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _scans(spark: SparkSession, directory: str, columns: list[str], prepare, symbols: DataFrame | None) -> DataFrame:
    """Union of one scan per file layout; ``prepare`` brings the lower-case columns of a scan to common types.

    Files whose column types differ (integer and double volumes, dates as texts) cannot share a scan, and a scan with one
    schema for all would fail or misread them.  Each scan keeps its own pruning and pushdown.
    """
    parts = []
    for paths in _layouts(symbol_files(spark, directory, symbols), columns):
        df = spark.read.parquet(*paths)
        named = {c.lower(): c for c in df.columns}
        parts.append(prepare(df.select(
            *[F.col(f"`{named[c]}`").alias(c) for c in columns],
            _file_symbol().alias("symbol"),
            F.col("_metadata.row_index").alias("_row"))))
    if not parts:
        raise MissingBarsError(f"no bar file of the symbols asked for in {directory}")
    return reduce(DataFrame.unionByName, parts)


def _moment(df: DataFrame, c: str) -> Column:
    """The column as a timestamp without time zone.

    Nanosecond files arrive as integers when ``spark.sql.legacy.parquet.nanosAsLong`` is
    set (Spark rejects them otherwise); texts that are no timestamps become missing.
    """
    kind = dict(df.dtypes)[c]
    if kind == "bigint":
        seconds = (F.floor(F.col(c) / 1000) / 1e6).cast("decimal(18,6)")
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    if kind == "string":
        return F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)")
    return F.col(c).cast("timestamp_ntz")


def _keep_one(df: DataFrame, keys: list[str], columns: list[str], pick) -> DataFrame:
    """One row per key by an aggregate, so copies of a key are combined before the shuffle.

    Picking column by column keeps the buffers primitive and the aggregation hash-based.
    """
    return df.groupBy(*keys).agg(*[pick(c, "_row").alias(c) for c in columns])


def load_daily(spark: SparkSession, directory: str, start: str, end: str, symbols: DataFrame | None = None) -> DataFrame:
    """Daily bars in [start, end]; of several rows for a date the first in the file stays.

    Column types may differ between files.  Only files of ``symbols`` are opened, if given.
    """
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    columns = [*PRICES, "volume"]

    def prepare(df: DataFrame) -> DataFrame:
        if dict(df.dtypes)["date"].startswith(("date", "timestamp")):
            # on the raw column, so that the bound reaches the scan
            df = df.where((F.col("date") >= lo) & (F.col("date") < F.date_add(hi, 1)))
        df = df.withColumn("date", F.to_date(_moment(df, "date"))).where(F.col("date").between(lo, hi))
        return df.select("symbol", "date", "_row", *[finite(F.col(c).cast("double")).alias(c) for c in columns])

    return _keep_one(_scans(spark, directory, ["date", *columns], prepare, symbols), ["symbol", "date"], columns, F.min_by)


def load_minutes(spark: SparkSession, directory: str, symbols: DataFrame | None = None) -> DataFrame:
    """Minute bars with values coerced to numbers; a repeated timestamp keeps its last row.

    Column types may differ between files.  Only files of ``symbols`` are opened, if given.
    """
    columns = [*PRICES, "volume"]
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    clean = lambda c: F.when(~F.isnan(number(c)), number(c))

    def prepare(df: DataFrame) -> DataFrame:
        df = df.select("symbol", "_row", _moment(df, "timestamp").alias("timestamp"), *[clean(c).alias(c) for c in columns])
        return df.dropna(subset=["timestamp", *PRICES])

    return _keep_one(_scans(spark, directory, ["timestamp", *columns], prepare, symbols), ["symbol", "timestamp"], columns,
                     F.max_by)


def write_symbol_files(df: DataFrame, directory: str, order: list[str]) -> None:
    """One <SYMBOL>.parquet file per symbol, rows in the given order, without the symbol column.

    The rows of a symbol stream through one task in batches.  A file gets its name when it is whole, so a task that is run
    again replaces what the lost one wrote.  ``directory`` must be shared by all executors; a null symbol is an error.
    """
    names = [c for c in df.columns if c != "symbol"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        import pyarrow.compute as pc
        from pyarrow import parquet

        symbol = writer = None

        def close() -> pa.RecordBatch:
            writer.close()
            system, at = _opened(f"{directory}/{symbol}.parquet")
            system.move(part, at)
            return pa.RecordBatch.from_arrays([pa.array([symbol], pa.string())], names=["symbol"])

        for batch in batches:
            column = batch.column("symbol")
            runs = pc.run_end_encode(column)
            start = 0
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if value is None:
                    raise ValueError("a bar without a symbol has no file")
                if value != symbol:
                    if writer is not None:
                        yield close()
                    symbol = value
                    system, part = _opened(f"{directory}/.{uuid4().hex}.part")
                    system.create_dir(part.rpartition("/")[0], recursive=True)
                    writer = parquet.ParquetWriter(part, batch.select(names).schema, filesystem=system)
                writer.write_batch(batch.select(names).slice(start, end - start))
                start = end
        if writer is not None:
            yield close()

    df.repartition("symbol").sortWithinPartitions("symbol", *order).mapInArrow(write, "symbol string").write.format(
        "noop").mode("overwrite").save()


def list_symbols(spark: SparkSession, directory: str) -> DataFrame:
    """Symbols of a folder, from file names only (no file is opened)."""
    return symbol_files(spark, directory).select("symbol")


def missing_symbols(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select("symbol").distinct().join(present.select("symbol").distinct(), "symbol", "left_anti")


def require_minutes(expected: DataFrame, present: DataFrame) -> None:
    first = [r.symbol for r in missing_symbols(expected, present).orderBy("symbol").limit(10).collect()]
    if first:
        raise MissingBarsError(f"minute data missing for daily symbols: {', '.join(first)}")


def session_cache(spark: SparkSession, path: str, expected: DataFrame, build, rebuild: bool = False) -> DataFrame:
    """Session features from the table at ``path``; only symbols it lacks are built.

    ``build(symbols)`` returns the features of the symbols in that DataFrame.  A symbol's partition is replaced as a whole,
    so building it again never doubles its rows.  Symbols stay texts, also where they look like numbers.
    """
    cached = _cached(spark, path) if not rebuild and _table_exists(spark, path) else None
    todo = expected.select("symbol").distinct() if cached is None else missing_symbols(expected, cached)
    if cached is None or not todo.isEmpty():
        build(todo).repartition("symbol").write.mode("overwrite").option(
            "partitionOverwriteMode", "static" if cached is None else "dynamic").partitionBy("symbol").parquet(path)
    return _cached(spark, path)


def _cached(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(path).schema.fields
    return spark.read.schema(StructType([StructField("symbol", StringType()) if f.name == "symbol" else f for f in fields])).parquet(path)


def _table_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        # anything else (rights, schema) must not lead to the table being replaced
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def bars_from_ticks(ticks: DataFrame, keys: list[str], order: Column | list[str]) -> DataFrame:
    """OHLCV bars of ticks (price, volume) grouped by ``keys``; ``order`` is a total order of ticks."""
    order = F.struct(*order) if isinstance(order, list) else order
    return ticks.groupBy(*keys).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"))
