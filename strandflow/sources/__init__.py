"""Sources: tables, literal elements, replicated sources, generated words, file streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEQ = "seq"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with its arrival position ``seq`` and whole seconds ``sec``."""
    return table(spark, sf_dir, "events").withColumns({SEQ: F.col("event_id"), "sec": F.unix_seconds(F.col("ts").cast("timestamp"))})


def elements(spark: SparkSession, values: Iterable, kind: str = "long") -> DataFrame:
    """A finite stream of scalars: (seq, value)."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{SEQ} long, value {kind}")


class ElementsBuilder:
    """Append values, then take them as a stream."""

    def __init__(self, kind: str = "long"):
        self.kind, self.values = kind, []

    def add(self, *values) -> ElementsBuilder:
        self.values.extend(values)
        return self

    def stream(self, spark: SparkSession) -> DataFrame:
        return elements(spark, self.values, self.kind)


def replicated(df: DataFrame, copies: int) -> DataFrame:
    """The source run ``copies`` times over: each row once a copy, tagged with ``_copy``; no shuffle."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def vocabulary(n: int = 128) -> list[str]:
    """``n`` distinct pronounceable words of 3 to 9 letters, made by rule."""
    onset, nucleus = "bcdfghklmnprstvz", "aeiou"
    out = []
    for i in range(n):
        x, word = i * 2654435761 % (1 << 32), ""
        for _ in range(2 + i % 3):
            word += onset[x % 16] + nucleus[x // 16 % 5]
            x //= 80
        out.append(word + "nrslt"[i // 3 % 5] + ("" if word not in out else str(i)))
    return out


def drawn(place: Column, size: int) -> Column:
    """A number below ``size`` for each position, spread evenly by two multiplications; any SQL can say the same."""
    x = (place % (1 << 31)) * 2654435761 % (1 << 32)
    x = (F.floor(x / 65536) + x % 65536 * 65536) * 40503 % (1 << 32)
    return (F.floor(x / 4096) % size).cast("int")


def words(spark: SparkSession, n: int, size: int = 128, partitions: int | None = None) -> DataFrame:
    """``n`` words (seq, value) drawn from the vocabulary by their position."""
    choose = F.element_at(F.array(*(F.lit(w) for w in vocabulary(size))), drawn(F.col("id"), size) + 1)
    return spark.range(0, n, 1, partitions).select(F.col("id").alias(SEQ), choose.alias("value"))


class GeneratorSource(DataSource):
    """A source in Python code: option ``spec`` names module:function; the function yields tuples for (instance, instances).

    Register with ``spark.dataSource.register(GeneratorSource)``, then
    ``spark.read.format("generator").schema(...).option("spec", ...).option("parallelism", n).load()``.
    """

    @classmethod
    def name(cls) -> str:
        return "generator"

    def schema(self) -> str:
        return f"{SEQ} long, value long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _GeneratorReader(self.options)


class _GeneratorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.spec, self.n = options["spec"], int(options.get("parallelism", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.n)]

    def read(self, partition: InputPartition):
        import importlib

        module, _, name = self.spec.partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.value, self.n)


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    """An unbounded stream of files; ``files_per_trigger`` is its back-pressure."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
