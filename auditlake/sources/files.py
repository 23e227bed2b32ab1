"""Folders of documents and checklist files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.names import base_name, file_media_type, page_media_type, suffix
from auditlake.operators.checklist import parse_checklist
from auditlake.schemas import SUFFIXES
from auditlake.shared import open_store
from auditlake.sources.folder import register


def any_case(suffixes: tuple[str, ...]) -> str:
    """A glob for the suffixes in any case, so that no other file is opened."""
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def described(files: DataFrame) -> DataFrame:
    """Adds name, suffix and media types to rows with a path; keeps the suffixes that can be read."""
    ext = suffix(F.col("path"))
    out = files.withColumns({"document_name": base_name(F.col("path")), "ext": ext}).where(F.col("ext").isin(*SUFFIXES))
    return out.withColumns({"page_media_type": page_media_type(F.col("ext")), "media_type": file_media_type(F.col("ext"))})


def scan_folder(spark: SparkSession, folder: str, strict: bool = False, content: bool = True) -> DataFrame:
    """The documents of a folder, not of its subfolders; none if there is no such folder.

    Empty files and names that start with a dot or an underscore are left out unless strict.
    Without content, files are listed and not opened.
    """
    register(spark)
    source = spark.read.format("document_folder").option("suffixes", ",".join(SUFFIXES)).option("content", str(content).lower())
    found = described(source.load(folder))
    return found if strict else found.where(~F.col("document_name").rlike("^[._]") & (F.col("length") > 0))


def require_folder(folder: str) -> None:
    """Fails with a message if there is no such folder."""
    from pyarrow import fs

    store, path = open_store(folder)
    if store.get_file_info(path).type != fs.FileType.Directory:
        raise FileNotFoundError(f"Folder not found: {folder}")


def with_content(files: DataFrame) -> DataFrame:
    """Listed files with their content; one that is gone by now has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for name in batch["path"]:
                store, path = open_store(name)
                try:
                    with store.open_input_stream(path, compression=None) as f:
                        content.append(f.read())
                except FileNotFoundError:
                    content.append(None)
            yield batch.assign(content=content)

    return files.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content binary")


def or_empty(spark: SparkSession, load: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What load gives, or nothing if its path does not exist."""
    try:
        found = load()
        found.schema  # noqa: B018  resolves the path
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (name, content) as files of a folder that all tasks reach; a name may begin with a subfolder's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(folder)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                store.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(content)
            yield batch[["name"]]

    files.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def data_urls(files: DataFrame) -> DataFrame:
    """Image files as data URLs."""
    url = F.concat(F.lit("data:"), F.col("page_media_type"), F.lit(";base64,"), F.base64("content"))
    return files.where(F.col("ext") != ".pdf").withColumn("url", url)


def checklist_text(spark: SparkSession, path: str) -> str | None:
    """The text of a checklist file, a page; None if there is no such file."""
    found = or_empty(spark, lambda: spark.read.text(path, wholetext=True), "value string").first()
    return found.value if found else None


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a checklist file; no file gives no rules."""
    text = or_empty(spark, lambda: spark.read.text(path, wholetext=True), "value string")
    return parse_checklist(text.select(F.lit("file").alias("checklist"), F.col("value").alias("text")))


def own_rules() -> str:
    """The checklist that comes with the package."""
    with open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "rules.md"), encoding="utf-8") as f:
        return f.read()
