"""Model services as pluggable providers, with deterministic stand-ins.

A provider is made once in each Python worker and maps rows in Arrow batches; a failing
row gives an error column, never a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheafline.scratch import materialize
from sheafline.shipping import ship

ship(__name__)

#: Keys that are broadcast at most: those of more than one in so many rows.
OFTEN = 1 << 12


def apply_provider(df: DataFrame, make: Callable[[], Callable], inputs: list[str], schema: str) -> DataFrame:
    """df with the provider's columns and `provider_error`.

    make() builds the model in the worker; the model takes a row's inputs and returns a
    dict by schema (``name type, ...``).
    """
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            found, errors = [], []
            for row in pdf[inputs].itertuples(index=False, name=None):
                try:
                    out = model(*row)
                    found.append([out.get(n) for n in names])
                    errors.append(None)
                except Exception as error:
                    found.append([None] * len(names))
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=names, dtype=object), pd.Series(errors, name="provider_error", dtype=object)], axis=1)

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{before}, {schema}, provider_error string")


def count_tokens(df: DataFrame, text: str, counter: Callable[[], Callable[[str], int]], name: str = "tokens") -> DataFrame:
    """df with the token count of a text; each distinct text is counted once. df is read more than once."""
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    return looked_up(df.withColumn("__key", key), counted_once(df.select(F.coalesce(F.col(text), F.lit("")).alias("__text")), counter, name), name).drop("__key")


def counted_once(texts: DataFrame, counter: Callable[[], Callable[[str], int]], name: str) -> DataFrame:
    """(__key, __n, name) of the distinct texts of texts (__text), by their digest, written once: no text is counted twice."""
    distinct = texts.groupBy(F.md5("__text").alias("__key")).agg(F.first("__text").alias("__text"), F.count("*").alias("__n"))
    counted = apply_provider(distinct, lambda: (lambda t, c=counter(): {name: c(t)}), ["__text"], f"{name} long")
    return materialize(counted.select("__key", "__n", name))


def looked_up(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """rows with names of table, by __key. table: __key, __n (how many rows have it), names.

    Keys that more than one in OFTEN rows have are fewer than OFTEN and are broadcast; only
    rows of other keys are shuffled.
    """
    often = F.col("__n") > (table.agg(F.sum("__n")).first()[0] or 0) // OFTEN
    met = rows.join(F.broadcast(table.where(often)), "__key", "left")
    rare = met.where("__n IS NULL").select(rows.columns).join(table.where(~often), "__key", "left")
    return met.where("__n IS NOT NULL").unionByName(rare).select(*rows.columns, *names)


def token_costs(rows: DataFrame, row: str, texts: str, counter: Callable[[], Callable[[str], int]], name: str = "costs") -> DataFrame:
    """(row, name array<long>): the token count of each of a row's texts, each distinct text of all rows counted once.

    rows: a key of rows and an array of texts; read more than once. A text that cannot be
    counted has a null; rows without a text are left out.
    """
    parts = rows.select(row, F.posexplode(texts).alias("__pos", "__text")).withColumn("__text", F.coalesce("__text", F.lit("")))
    costs = looked_up(parts.select(row, "__pos", F.md5("__text").alias("__key")), counted_once(parts.select("__text"), counter, "__cost"), "__cost")
    listed = F.sort_array(F.collect_list(F.struct("__pos", "__cost")))
    return costs.groupBy(row).agg(F.transform(listed, lambda c: c["__cost"]).alias(name))


def word_counter() -> Callable[[str], int]:
    """A stand-in tokenizer: words."""
    return lambda text: len(text.split())


def fake_completion() -> Callable:
    """A stand-in language model: a record derived from the prompt's digest."""

    def run(prompt: str) -> dict:
        mark = hashlib.sha256((prompt or "").encode()).hexdigest()
        return {"raw_text": f'{{"ly":"COMPLETE","it":[{{"n":"Item {mark[:4]}","qty":1,"p":1000,"t":1000}}],"mn":"Shop {mark[4:6]}","ta":1000}}', "finish_reason": "stop"}

    return run


def fake_lines() -> Callable:
    """A stand-in recogniser: one line for each text line of the payload."""

    def run(content: bytes) -> dict:
        texts = bytes(content or b"").decode("utf-8", "replace").splitlines()
        return {"texts": texts, "scores": [0.9] * len(texts)}

    return run


def read_images(spark: SparkSession, path: str, names: str = "\\.(jpe?g|png)$") -> DataFrame:
    """(path, length, content) of a folder's images, by a pattern of their lower-case names; what a query leaves out is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(names)).select("path", "length", "content")


def fetch(df: DataFrame, url: str, get: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """df with `content` of each URL by a client that get() makes; failures leave provider_error."""
    return apply_provider(df, lambda: (lambda u, g=get(): {"content": g(u)}), [url], "content binary")
