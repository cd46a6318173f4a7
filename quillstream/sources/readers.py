"""Sources and sinks: landed JSON pages, paged HTTP, JDBC, WAV chunks, event sink, snapshots."""

from __future__ import annotations

import json
import struct
import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, ShortType

from ..operators.sessions import persisted
from ..schemas import SEGMENT_ROWS_DDL

PAGE_DDL = "verses array<struct<id:bigint,verse_key:string,words:array<struct<id:bigint,char_type_name:string,text_uthmani:string,text_imlaei:string>>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON document a file, by a fixed schema (no inference)."""
    return spark.read.schema(PAGE_DDL).option("multiLine", True).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric column (the driver jar is yours)."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def with_retry(get: Callable[[], str], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> str:
    """Call ``get``; after failure n (from 0) wait 2^n seconds, and raise the last error."""
    for n in range(tries):
        try:
            return get()
        except OSError:
            if n == tries - 1:
                raise
            wait(2.0**n)
    raise ValueError("tries must be positive")


def paged(get: Callable[[int], dict]) -> Iterator[dict]:
    """Pages 1, 2, ... until one names no next page."""
    page: int | None = 1
    while page:
        body = get(page)
        yield body
        page = (body.get("pagination") or {}).get("next_page")


class PagedSource(DataSource):
    """``format("paged")``: options url (with {chapter} and {page}) and chapters; a partition
    is a chapter, its pages follow each other. Rows are (chapter, page, body)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "chapter int, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.chapters = options["url"], int(options["chapters"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in range(1, self.chapters + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def get(page: int) -> dict:
            url = self.url.format(chapter=partition.value, page=page)

            def once() -> str:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    return answer.read().decode()

            return json.loads(with_retry(once))

        for n, body in enumerate(paged(get), 1):
            yield partition.value, n, json.dumps(body, ensure_ascii=False)


def read_wav(spark: SparkSession, path: str, rate: int = 16000, chunk_ms: int = 250) -> DataFrame:
    """path, chunk, samples of 16-bit mono WAV files; any other format is an error."""
    size = rate * chunk_ms // 1000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                pcm = decode_wav(r.content, rate)
                rows = [(r.path, i // size, list(pcm[i : i + size])) for i in range(0, len(pcm), size)]
                yield pd.DataFrame(rows, columns=["path", "chunk", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, chunk int, samples array<smallint>")


def decode_wav(data: bytes, rate: int) -> tuple[int, ...]:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, pcm = 12, None, b""
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif tag == b"data":
            pcm = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or (form[0], form[1], form[2], form[5]) != (1, 1, rate, 16):
        raise ValueError(f"expected mono 16-bit PCM at {rate} Hz")
    return struct.unpack(f"<{len(pcm) // 2}h", pcm[: len(pcm) // 2 * 2])


def encode_wav(samples: list[float], rate: int = 16000) -> bytes:
    """Clipped floats as a mono 16-bit WAV file."""
    pcm = struct.pack(f"<{len(samples)}h", *(round(max(-1.0, min(1.0, s)) * 32767) for s in samples))
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def as_messages(events: DataFrame, **extra) -> DataFrame:
    """One JSON message an event, as clients get it; null fields are left out."""
    cols = [F.col(c) for c in ("event_id", "type", "state", "refers_to") if c in events.columns]
    return events.select("session_id", F.to_json(F.struct(*cols, F.col("payload"), *(F.lit(v).alias(k) for k, v in extra.items()))).alias("message"))


def append_events(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of the event log, without positions and notices. A batch has a folder
    of its own, so a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        persisted(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def segment_stream(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Rows of live sessions from files that land in a folder. ``most`` files a micro-batch: under
    load rows wait in the folder, none is dropped."""
    return spark.readStream.schema(SEGMENT_ROWS_DDL).option("maxFilesPerTrigger", most).parquet(path)


def audio_stream(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """Chunks of live audio that land as <session>/<seq>.pcm (16-bit mono): session_id, seq,
    bytes, samples. The sessions' rate guard works on ``bytes``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    named = raw.option("pathGlobFilter", "*.pcm").option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(folder)
    part = lambda n: F.regexp_extract("path", r"([^/]+)/([0-9]+)\.pcm$", n)
    return named.select(part(1).alias("session_id"), part(2).cast("int").alias("seq"), F.col("length").alias("bytes"), pcm_samples("content").alias("samples"))


@F.pandas_udf(ArrayType(ShortType()))
def pcm_samples(content: pd.Series) -> pd.Series:
    """Little-endian 16-bit samples; an odd last byte is dropped."""
    return content.map(lambda x: np.frombuffer(x[: len(x) // 2 * 2], "<i2"))


def snapshot(df: DataFrame, folder: str, day: date, kept: list[str]) -> list[str]:
    """Write the day's snapshot; a second one of a day replaces the first. Of the days ``kept``
    so far, those that have become too old."""
    df.write.mode("overwrite").parquet(f"{folder}/{day.isoformat()}")
    return snapshots_to_drop(kept, day)


def reload(df: DataFrame, path: str) -> None:
    """Truncate and reload: running it twice leaves one copy."""
    df.write.mode("overwrite").parquet(path)


def snapshots_to_drop(days: list[str], today: date, keep: int = 14) -> list[str]:
    """Of dated snapshots (yyyy-mm-dd), those older than ``keep`` days."""
    return sorted(d for d in days if date.fromisoformat(d) < today - timedelta(days=keep))


def transcripts(df: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """text: the preferred transcript, or the other one where it is missing."""
    return df.withColumn("text", F.coalesce(preferred, fallback))
