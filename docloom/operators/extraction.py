"""Model-shaped functions: embedding, completion and scoring as Arrow batches, with deterministic stand-ins.

A model is any callable on a list of texts.  It is made once per Python worker by a factory, so weights
are loaded once, and texts are sent once per distinct stripped value.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from docloom.functions.scalar import page_number, strip, strip_fence

BATCH = 32
_made: dict = {}


def model_name(factory: Callable[[], Callable]) -> str:
    """A name that two factories share only if code and enclosed values are the same."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def once(factory: Callable[[], Callable], name: str | None = None) -> Callable:
    """The product of the factory of that name, made once per worker; a failure is remembered and raised again."""
    key = name or model_name(factory)
    if key not in _made:
        try:
            _made[key] = factory()
        except Exception as e:
            _made[key] = e
    if isinstance(_made[key], Exception):
        raise _made[key]
    return _made[key]


def retried(call: Callable, tries: int = 3, wait: float = 1.0, on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)):
    """The call's result; the named errors are retried with doubling waits."""
    for k in range(tries):
        try:
            return call()
        except on:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def _lenient(model: Callable, texts: list) -> list:
    """Answers to all texts; where the batch fails, one by one, with null for a text that fails alone too."""
    try:
        return list(retried(lambda: model(texts)))
    except Exception:
        if len(texts) == 1:
            return [None]
        return [answer for text in texts for answer in _lenient(model, [text])]


def _batched(factory: Callable[[], Callable], returns, batch: int, lenient: bool = False):
    """``lenient``: a text that the model fails on is null, instead of failing the task and all its rows."""
    name = model_name(factory)

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(factory, name)
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                piece = texts[i : i + batch]
                out += _lenient(model, piece) if lenient else list(retried(lambda piece=piece: model(piece)))
            yield pd.Series(out, index=part.index)

    return run


def embed(rows: DataFrame, text: str, factory: Callable[[], Callable], batch: int = BATCH) -> DataFrame:
    """Adds embedding: one call per distinct stripped text, joined back.

    Blank texts, which may be many rows, share one vector, which is broadcast instead of joined by its key.
    """
    udf = _batched(factory, ArrayType(FloatType()), batch)
    plain = strip(F.coalesce(F.col(text), F.lit("")))
    keyed = rows.withColumn("_key", F.when(plain != "", F.sha2(plain, 256)))
    distinct = keyed.groupBy("_key").agg(F.first(plain).alias("_text")).withColumn("embedding", udf("_text")).drop("_text")
    filled = keyed.filter("_key IS NOT NULL").join(distinct.filter("_key IS NOT NULL"), "_key").drop("_key")
    one = F.broadcast(distinct.filter("_key IS NULL").select(F.lit("").alias("_key"), "embedding"))
    blank = keyed.filter("_key IS NULL").withColumn("_key", F.lit("")).join(one, "_key").drop("_key")
    return filled.unionByName(blank)


def complete(rows: DataFrame, prompt: Column, factory: Callable[[], Callable], name: str = "answer", batch: int = BATCH) -> DataFrame:
    """Adds a model's answer to each prompt, null where the model fails."""
    return rows.withColumn(name, _batched(factory, StringType(), batch, lenient=True)(prompt))


ITEM = "struct<title: string, text: string, page: string, section: string, score: string>"


def parse_records(answer: Column) -> Column:
    """A model's JSON answer as an array of records: fence dropped, one object counts as a list, bad JSON as none.

    Fields come as the JSON text they had where they are no strings.
    """
    clean = strip_fence(answer)
    one = F.concat(F.lit("["), clean, F.lit("]"))
    wrapped = F.when(clean.startswith("{"), one).when(clean.startswith("["), clean)
    return F.coalesce(F.from_json(wrapped, f"array<{ITEM}>"), F.array().cast(f"array<{ITEM}>"))


def records(rows: DataFrame, answer: Column, keep: list[str]) -> DataFrame:
    """One row per record: text filled, page a number (all digits of a string), section stripped."""
    out = rows.select(*keep, F.posexplode(parse_records(answer)).alias("item_no", "_r"))
    page = page_number(F.concat(F.lit('"'), F.col("_r.page")))
    return out.select(*keep, "item_no", strip("_r.title").alias("title"), strip("_r.text").alias("text"), page.alias("page"), F.when(strip("_r.section") != "", strip("_r.section")).alias("section"), F.col("_r.score").try_cast("double").alias("score")).filter("text <> ''")


def without_score_rows(requirements: DataFrame, marks: list[str]) -> DataFrame:
    """Requirements that are no scoring items (by words of their text)."""
    out = requirements
    for m in marks:
        out = out.filter(~F.contains("text", F.lit(m)))
    return out


#: The kinds of relation that results must name.
RELATIONS = ("related", "prerequisite", "complementary", "derived_from")


def relation_edges(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges (source, target, rel_type) between known patterns: no self edges, unknown types are 'related', a pair once."""
    known = patterns.select(F.col("id").alias("_id"))
    good = raw.filter("source <> target").join(known.withColumnRenamed("_id", "source"), "source", "left_semi").join(known.withColumnRenamed("_id", "target"), "target", "left_semi")
    kind = F.when(F.col("rel_type").isin(*RELATIONS), F.col("rel_type")).otherwise("related")
    return good.groupBy("source", "target").agg(F.min(kind).alias("rel_type"))


def patterns_from_sections(candidates: DataFrame, order: list[str], answer: Column, prefix: str = "SP") -> DataFrame:
    """Codes are given before the call, so they do not depend on which calls fail; failed ones are dropped."""
    from pyspark.sql import Window

    numbered = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))
    return numbered.withColumn("code", F.format_string(f"{prefix}%03d", F.col("_n"))).withColumn("_answer", answer).filter("_answer IS NOT NULL").drop("_n")


def hash_embedder(dim: int = 64):
    """A factory for the deterministic stand-in of an embedding model."""

    def factory():
        import hashlib

        def run(texts):
            out = []
            for t in texts:
                v = [(hashlib.md5(f"{t}:{i}".encode()).digest()[0] - 128) / 128 for i in range(dim)]
                n = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / n for x in v])
            return out

        return run

    factory.__qualname__ = f"hash_embedder_{dim}"
    return factory
