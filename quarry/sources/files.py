"""Sources and sinks: ZIP archives, layered stores, vector records, hex captures, JSON columns, final files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYERS = ("code", "raw", "pivot", "overall")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its path's ending: parquet, csv (with header), json lines or orc; Parquet otherwise. For workbooks see quarry.sources.workbook."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return reader.option("header", True).csv(path)
    if ending in ("json", "jsonl"):
        return reader.json(path)
    if ending == "orc":
        return reader.orc(path)
    return reader.parquet(path)


def unzip(spark: SparkSession, path: str, ending: str = "", most_bytes: int = 256 << 20) -> DataFrame:
    """(archive, member, content) of the files in ZIP archives. A member above ``most_bytes`` unpacked is an error, not a cut.

    Archives are read by Spark, so any store that it knows will do, and each is unpacked in the task that read it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if info.is_dir() or not info.filename.endswith(ending):
                            continue
                        if info.file_size > most_bytes:
                            raise ValueError(f"{name}: {info.filename} has {info.file_size} bytes")
                        yield pd.DataFrame({"archive": [name], "member": [info.filename], "content": [archive.read(info)]})

    return files.mapInPandas(run, "archive string, member string, content binary")


def csv_rows(members: DataFrame, schema: str, header: bool = True) -> DataFrame:
    """(archive, member, and the schema's columns): rows of CSV files in archives, in UTF-8."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    lines = members.select("archive", "member", F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.trim("line") != "")
    rows = lines.where("n > 0") if header else lines
    return rows.select("archive", "member", F.from_csv("line", schema).alias("row")).select("archive", "member", "row.*")


class LayeredStore:
    """Tables in the layers code, raw, pivot and overall under one root. Raw tables are only appended to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer}")
        return f"{self.root}/{layer}/{name}"

    def write(self, df: DataFrame, layer: str, name: str, partition_by: Sequence[str] = ()) -> None:
        """Append to raw; in other layers replace the table, or only the partitions that ``df`` has rows of."""
        writer = df.write.mode("append" if layer == "raw" else "overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(layer, name))

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, name))


def upsert_records(old: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """Records of both, the new one where both have the key; of several new ones of a key, the one with the least hash of its fields."""
    fields = [F.col(f"`{c}`") for c in new.columns]
    latest = new.groupBy(F.col(f"`{key}`")).agg(F.min_by(F.struct(*fields), F.xxhash64(*fields)).alias("__record")).select("__record.*")
    return latest if old is None else old.join(latest.select(F.col(f"`{key}`")), key, "left_anti").unionByName(latest)


def vector_record(doc_id: Column, vector: Column, year: Column, month: Column, item: Column, document: Column) -> list[Column]:
    """The four fields of a vector store's record; metadata is a struct, so that filters on it prune."""
    meta = F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), item.alias("item"))
    return [doc_id.cast("string").alias("id"), vector.cast("array<float>").alias("vector"), meta.alias("metadata"), document.alias("document")]


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with the fields of a JSON column; malformed JSON gives nulls."""
    return df.withColumn("__j", F.from_json(column, schema)).select(*(f"`{c}`" for c in df.columns), "__j.*")


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A final file for people: CSV with header, or Parquet."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
