"""The whole extraction as one plan: payloads in, one answer for each request out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.geometry import POLYS
from sheafline.operators import loops, ocr, postprocess, receipts, routing
from sheafline.scratch import materialize
from sheafline.shipping import ship
from sheafline.sources.providers import apply_provider, token_costs, word_counter
from sheafline.sources.requests import decode_base64, payload_error, reference_id, split_valid
from sheafline.streaming import detector

ship(__name__)


@dataclass(frozen=True)
class Rules:
    """User-maintained lists, normalised: see sources.patterns."""

    items: Sequence[str] = ()
    merchants: Sequence[str] = ()
    names: Sequence[tuple[str, str]] = ()
    as_of_year: int = 2026
    strict_reference: bool = False
    template: str = field(default="Read the receipt.\n")
    #: Tokens that a prompt of recognised lines has at most.
    input_cap: int = ocr.INPUT_CAP


def typed(completions: DataFrame, rules: Rules) -> DataFrame:
    """Completions (ref, raw_text, finish_reason) as clean receipts with `trigger` and `has_data`."""
    got = receipts.to_receipt(receipts.parse_ladder(completions))
    got = postprocess.postprocess(got, rules.items, rules.merchants, rules.names, strict_reference=rules.strict_reference)
    got = loops.detect(loops.scrub(got, rules.strict_reference), rules.strict_reference)
    got = got.withColumn("has_data", receipts.has_data())
    return got.withColumn("trigger", routing.trigger(~F.col("is_valid"), F.col("finish_reason"), F.col("loop_reason"), F.col("has_data")))


def boxed(texts: Column, scores: Column, polys: Column) -> Column:
    """Lines at the recogniser's boxes; one that gives none has a row of its own for each text."""
    y = lambda k: (k * 20).cast("int")
    rows = F.transform(F.arrays_zip(texts.alias("t"), scores.alias("s")), lambda z, k: ocr.line(z["t"], F.lit(0), y(k), F.length(z["t"]) * 10, y(k) + 18, z["s"]))
    return F.when(polys.isNull(), rows).otherwise(ocr.zip_lines(texts, scores, polys))


def fitted(seen: DataFrame, rules: Rules, counter: Callable[[], Callable[[str], int]]) -> DataFrame:
    """seen (row_id, lines) with the prompt of as many of its lines as the input cap holds; null where none can be made.

    seen is written down first, as it is read again with the counts; the template and each distinct line are counted once.
    """
    seen = materialize(seen)
    parts = F.concat(F.array(F.lit(rules.template)), F.transform("lines", lambda h: ocr.text_block(F.array(h))))
    seen = seen.join(token_costs(seen.select("row_id", parts.alias("parts")), "row_id", "parts", counter, "__costs"), "row_id", "left")
    costs = F.transform("__costs", lambda c: c.cast("int"))
    seen = seen.withColumn("__costs", costs).withColumn("__fit", ocr.fit_lines(F.slice("__costs", 2, F.size("__costs") - 1), F.col("__costs")[0], rules.input_cap)).drop("__costs")
    block = ocr.text_block(F.slice("lines", 1, F.coalesce("__fit.keep", F.lit(0))))
    return seen.withColumn("prompt", F.when(F.col("__fit.status") == "fit", F.concat(F.lit(rules.template), block))).drop("__fit")


def streamed(df: DataFrame, complete: Callable[[], Callable]) -> DataFrame:
    """df with raw_text, finish_reason and provider_error of a model that may write piece by piece.

    A model that returns a dict is asked once; one that returns an iterator of texts is
    read as it writes, and stopped (hallu_abort) when what it has written loops.
    """
    def make() -> Callable:
        model = complete()

        def run(prompt: str) -> dict:
            out = model(prompt)
            return out if isinstance(out, dict) else detector.written(out)

        return run

    return apply_provider(df, make, ["prompt"], "raw_text string, finish_reason string")


def extract(requests: DataFrame, complete: Callable[[], Callable], recognise: Callable[[], Callable], rules: Rules = Rules(), stages: Callable[[DataFrame], DataFrame] | None = None,
            counter: Callable[[], Callable[[str], int]] = word_counter) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected) of requests (images_url, images_base64, reference_id): one answer for each that can be served.

    complete makes a model: prompt -> raw_text, finish_reason, or an iterator of texts.
    recognise makes a recogniser: payload -> texts, scores and, if it knows, polys (lists
    of x, y). Requests with URLs need content fetched first (providers.fetch). stages:
    image stages over rows with content, e.g. plans.stages.prepare with its providers;
    answers then carry verdict, reject_reason, route, image_quality, stages and total_ms. Each model is asked once for
    a request, only triggered requests are recognised and completed again, and only
    their payloads are written down on the way. Reference ids may repeat.
    """
    good, rejected = split_valid(requests)
    good = good.withColumn("content", decode_base64(F.col("images_base64")[0]))
    good = good.withColumn("error", payload_error(F.col("content"))).withColumn("ref", reference_id(F.col("reference_id"), F.col("content")))
    rejected = rejected.unionByName(good.where("error IS NOT NULL").select(*requests.columns, F.array("error").alias("violations")))
    served = good.where("error IS NULL").select("ref", "content")
    more = ("verdict", "reject_reason", "route", "image_quality", "stages", "total_ms") if stages else ()
    served = stages(served).select("ref", "content", *more) if stages else served
    primary = streamed(served.withColumn("prompt", F.concat(F.lit(rules.template), F.base64("content"))), complete).drop("prompt")
    primary = typed(primary, rules)
    primary = primary.withColumn("content", F.when(F.col("trigger").isNotNull(), F.col("content")))

    def fallback(hit: DataFrame) -> DataFrame:
        seen = apply_provider(hit.select("row_id", "content"), recognise, ["content"], f"texts array<string>, scores array<double>, polys {POLYS}").drop("provider_error")
        lines = ocr.merge_rows(ocr.keep_lines(boxed(F.col("texts"), F.col("scores"), F.col("polys"))))
        seen = fitted(seen.select("row_id", lines.alias("lines")), rules, counter)
        again = streamed(seen, complete)
        out = receipts.to_receipt(receipts.parse_ladder(again))
        empty = ~F.col("is_valid") | F.col("provider_error").isNotNull() | F.col("prompt").isNull() | (F.size("lines") == 0)
        out = out.withColumn("__swept", ocr.sweep_datetime(F.col("transaction_date"), F.col("transaction_time"), F.col("lines"), rules.as_of_year))
        out = out.withColumn("transaction_date", F.col("__swept.date")).withColumn("transaction_time", F.col("__swept.time"))
        out = postprocess.postprocess(receipts.fail_safe(out, empty), rules.items, rules.merchants, rules.names, strict_reference=rules.strict_reference)
        # Joined to the triggered rows; a scan here keeps its models at one call too.
        return materialize(out.withColumn("has_data", receipts.has_data()).select("row_id", *receipts.SCALARS, "items", "has_data"))

    return routing.with_fallback(primary, fallback, more=more), rejected
