"""A data source of payloads behind URLs: ``spark.read.format("payloads")``."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from sheafline.shipping import ship

ship(__name__)

SCHEMA = "url string, length long, content binary, attempts int, error string"
#: URLs of a task, tries, seconds between tries (doubled each time) and for an answer, and bytes of a payload at most.
PER_TASK, TRIES, PAUSE, TIMEOUT, MOST_BYTES = 64, 3, 0.1, 10.0, 64 << 20


@dataclass
class Part(InputPartition):
    urls: list[str]


def get(url: str, timeout: float, most: int) -> bytes:
    """The payload behind an http(s) URL; other schemes would reach files of the worker."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("only http and https are read")
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        data = answer.read(most + 1)
    if len(data) > most:
        raise ValueError(f"more than {most} bytes")
    return data


class PayloadReader(DataSourceReader):
    def __init__(self, urls: list[str], options: dict):
        self.urls, self.options = urls, options
        self.number = lambda name, value: type(value)(options.get(name, value))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters by url leave out what they exclude before anything is fetched; the others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("url",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.urls = [u for u in self.urls if u in wanted]
            elif not (isinstance(f, IsNotNull) and f.attribute == ("url",)):
                yield f

    def partitions(self) -> list[Part]:
        n = self.number("urlspertask", PER_TASK)
        return [Part(self.urls[k : k + n]) for k in range(0, len(self.urls), n)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        """A row for each URL: its payload, or what the last try failed with."""
        tries, pause, bodies = self.number("tries", TRIES), self.number("pause", PAUSE), self.options.get("content", "true").lower() != "false"
        for url in partition.urls:
            data, error, n = None, None, 0
            while n < tries and data is None:
                if n:
                    time.sleep(pause * 2 ** (n - 1))
                n += 1
                try:
                    data, error = get(url, self.number("timeout", TIMEOUT), self.number("mostbytes", MOST_BYTES)), None
                except Exception as found:
                    error = f"{type(found).__name__}: {found}"
                    if isinstance(found, ValueError):
                        break  # another try would end alike
            yield (url, None if data is None else len(data), data if bodies else None, n, error)


class Payloads(DataSource):
    """Options: urls (a JSON list), tries, pause, timeout, mostBytes, urlsPerTask, and content=false for lengths alone.

    A list that a driver cannot hold is a table: providers.fetch reads from one.
    """

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(json.loads(self.options.get("urls", "[]")), {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Payloads)


def client(tries: int = TRIES, timeout: float = TIMEOUT) -> Callable[[], Callable[[str], bytes]]:
    """The same tries as a client for providers.fetch, which takes its URLs from a table."""
    def make() -> Callable[[str], bytes]:
        def one(url: str) -> bytes:
            for k in range(tries):
                try:
                    return get(url, timeout, MOST_BYTES)
                except Exception as found:
                    if k + 1 == tries or isinstance(found, ValueError):
                        raise
                    time.sleep(PAUSE * 2**k)

        return one

    return make
