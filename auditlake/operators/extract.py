"""The hook for a model, or any other reader of files: a function from a file to a reply."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from inspect import Parameter, signature
from itertools import islice
from typing import NamedTuple
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.pdf import page_count
from auditlake.schemas import MAX_PAGES
from auditlake.shared import open_store


#: Bytes and rows of rendered pages that go on together.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


class Calls(NamedTuple):
    """How a reader is called: so many calls of a task at once, so often again after a failure, each time after
    twice the wait in seconds; ledger is a folder that all tasks reach, where every good reply is kept, so that a
    task that runs again repeats no call."""

    at_once: int = 1
    again: int = 0
    wait: float = 0.1
    ledger: str | None = None


class Brief(NamedTuple):
    """What is known of a file when it is judged: the checklist as lines, and its summary."""

    rules: str
    document_type: str
    summary: str
    language: str
    metadata: dict[str, str]


class Ledger:
    """Replies by request, one file each; a reply is moved into place when it is whole."""

    def __init__(self, folder: str):
        self.store, self.folder = open_store(folder)

    def place(self, path: str, content: bytes | None, more: tuple) -> str:
        seen = hashlib.sha256(json.dumps([path, more], default=str).encode() + hashlib.sha256(content or b"").digest()).hexdigest()
        return f"{self.folder}/{seen[:2]}/{seen}"

    def get(self, place: str) -> str | None:
        try:
            with self.store.open_input_stream(place) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, place: str, reply: str) -> None:
        self.store.create_dir(place.rpartition("/")[0], recursive=True)
        half = f"{place}.{uuid4().hex}"
        with self.store.open_output_stream(half, compression=None) as out:
            out.write(reply.encode())
        self.store.move(half, place)


def takes_brief(read: Callable) -> bool:
    """Whether a reader has a third place for what is known of the file."""
    places = [p for p in signature(read).parameters.values() if p.kind in (Parameter.POSITIONAL_ONLY, Parameter.POSITIONAL_OR_KEYWORD) and p.default is Parameter.empty]
    return len(places) >= 3


def answered(files: DataFrame, read: Callable[..., str], into: str = "reply", calls: Calls = Calls(), rules: str = "", empty: str | None = None) -> DataFrame:
    """files with the reader's reply to each.  A failing call becomes an error reply, never a failed run.

    With empty, that is the reply to files without content, and the reader is not asked.

    A reader with three places also gets a Brief, from the columns document_type, summary, language
    and metadata where files has them.  It is called in tasks; repartition files to set how many run.
    """
    brief = takes_brief(read)
    known = [c for c in Brief._fields[1:] if c in files.columns]
    bare = "content" not in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger = Ledger(calls.ledger) if calls.ledger else None

        def ask(file) -> str:
            path, content, *given = file
            if empty is not None and not content:
                return empty
            more = (Brief(**({"rules": rules, "document_type": "unknown", "summary": "", "language": "unknown", "metadata": {}} | dict(zip(known, given, strict=True)))),) if brief else ()
            place = ledger.place(path, content, (into, *more)) if ledger else ""
            reply = ledger.get(place) if ledger else None
            for k in range(calls.again + 1):
                if reply is not None:
                    break
                try:
                    reply = read(path, content, *more)
                    if ledger and reply is not None:
                        ledger.put(place, reply)
                except Exception as e:  # the caller's function may fail in any way
                    if k == calls.again:
                        return json.dumps({"error": str(e)})
                    time.sleep(calls.wait * 2**k)
            return reply

        with ThreadPoolExecutor(calls.at_once) as pool:
            for batch in batches:
                contents = [None] * len(batch) if bare else batch["content"]
                rows = zip(batch["path"], contents, *([dict(x) for x in batch[c]] if c == "metadata" else batch[c] for c in known), strict=True)
                yield batch.assign(**{into: list(pool.map(ask, rows))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{schema}, `{into}` string")


def extracted(files: DataFrame, read: Callable[..., str], calls: Calls = Calls()) -> DataFrame:
    """(doc_key, reply) of each file."""
    return answered(files.select("path", *[c for c in ("content",) if c in files.columns]), read, "reply", calls).select(F.col("path").alias("doc_key"), "reply")


def rendered_pages(files: DataFrame, render: Callable[[str, bytes | None], Iterator[bytes]], most: int = MAX_PAGES) -> DataFrame:
    """(doc_key, page_no, image) of the first pages of each file; a file that cannot be rendered has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                path, content = (batch.column(c)[k].as_py() for c in range(2))
                try:
                    images = list(islice(render(path, content), most))
                except Exception:  # the caller's function may fail in any way
                    images = []
                rows += [(path, no, image) for no, image in enumerate(images, 1)]
                size += sum(len(x or b"") for x in images)
                # pages of many files go on together, but never more than a task can well hold
                if rows and (size >= BATCH_BYTES or len(rows) >= BATCH_ROWS or k + 1 == batch.num_rows):
                    parts = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(parts, ["doc_key", "page_no", "image"])
                    rows, size = [], 0

    return files.select("path", "content").mapInArrow(run, "doc_key string, page_no int, image binary")


def shown_pages(files: DataFrame, render: Callable[[str, bytes | None], Iterator[bytes]], most: int = MAX_PAGES) -> DataFrame:
    """(doc_key, page_no, url): what a model is shown of each file, images as they are and PDFs page by page; others have no rows."""
    url = F.concat(F.lit("data:"), F.col("page_media_type"), F.lit(";base64,"), F.base64("content"))
    images = files.where((F.col("ext") != ".pdf") & F.col("page_media_type").isNotNull()).select(F.col("path").alias("doc_key"), F.lit(1).alias("page_no"), url.alias("url"))
    pages = rendered_pages(files.where(F.col("ext") == ".pdf"), render, most)
    return images.unionByName(pages.select("doc_key", "page_no", F.concat(F.lit("data:image/jpeg;base64,"), F.base64("image")).alias("url")))


def measured(files: DataFrame, count: Callable[[str, bytes | None], int], picture: Callable[[bytes | None], str]) -> DataFrame:
    """files with page_count, of a PDF what count says and 1 if it fails or for any other file, and preview_base64."""

    def pages(path: str, ext: str, content: bytes | None) -> int:
        try:
            return int(count(path, content)) if ext == ".pdf" else 1
        except Exception:  # the caller's function may fail in any way
            return 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = [pages(*x) for x in zip(batch["path"], batch["ext"], batch["content"], strict=True)]
            yield batch.assign(page_count=counted, preview_base64=[picture(c) for c in batch["content"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{schema}, page_count int, preview_base64 string")


def page_counts(files: DataFrame, count: Callable[[str, bytes | None], int] = page_count) -> DataFrame:
    """(doc_key, page_count) of each file."""
    return measured(files.select("path", "ext", "content"), count, lambda content: "").select(F.col("path").alias("doc_key"), "page_count")
