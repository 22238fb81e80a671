"""Mixing sources to target shares of a corpus's tokens, repeating small sources a capped number of times.

Tokens are counted once per document with a public tokenizer and kept in a narrow checkpoint;
what is gathered per source is a handful of sums. A source's rate is its share of the total
over its tokens; a document is used ``floor(rate)`` times and once more if a hash of its key, seeded, falls
below the fraction. Nothing but the sums is shuffled, so a source with most rows costs no task more than its share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import checkpoint, small_side, spread

#: The tokenizer if no path is given: a file of the folder of public tokenizers.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in place of the text; a null text has none."""
    others = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for b in batches:
            counts = [len(e.ids) for e in t.encode_batch([x or "" for x in b.column(len(others)).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*others, out])

    return spread(df.select(*others, text), 1).mapInArrow(run, f"{kinds}, {out} bigint")


def source_name(c: Column) -> Column:
    """A source's spelling made even: case, blanks, and hyphen for underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def rates(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, n_docs, n_tokens, target_share, max_repeats, rate) of all sources.

    ``rate`` is how often a document of the source is used on average: what the source's share of the total
    asks for, at most ``max_repeats``. The total is ``total_tokens`` or else the largest that all sources
    can fill within their caps, so that the shares are those asked for. A source without a target has
    rate 0; so has one without tokens, which then doesn't hold the total down.
    """
    sums = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    goal = targets.groupBy(source_name(F.col("source")).alias("_s")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = sums.join(goal, sums["source"] == goal["_s"], "full").select(F.coalesce("source", "_s").alias("source"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    room = F.when((F.col("n_tokens") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("n_tokens") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(room).over(Window.partitionBy(F.lit(1)))
    rate = F.when(room.isNotNull(), F.least(F.col("target_share") * F.col("_total") / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.withColumn("_total", total).select("source", "n_docs", "n_tokens", "target_share", "max_repeats", F.round(rate, 9).alias("rate"))


def use_counts(documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 42, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, and the rates: (key, source, n_tokens, n_uses), see ``rates``.

    Every row of ``documents`` is a document; unused ones have 0 uses. A null source has no
    target; rows with a null key share one draw.
    """
    rows = documents.select(F.col(key), source_name(F.col("source")).alias("source"), "text")
    counted = checkpoint(count_tokens(rows, tokenizer=tokenizer))
    per_source = checkpoint(rates(counted, targets, total_tokens))
    goal = small_side(per_source.where("source is not null").select(F.col("source").alias("_s"), "rate"), 10_000)
    joined = counted.join(goal, counted["source"] == goal["_s"], "left")
    rate = F.coalesce("rate", F.lit(0.0))
    uses = F.floor(rate) + F.when(_uniform(F.col(key), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(key, "source", "n_tokens", uses.cast("int").alias("n_uses")), per_source


def report(uses: DataFrame, per_source: DataFrame) -> DataFrame:
    """Per source its documents, tokens, target, rate, tokens used, most uses and actual share."""
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"), F.max("n_uses").alias("most_uses"))
    used = used.select(F.col("source").alias("_s"), "used_tokens", "most_uses")
    both = per_source.join(used, per_source["source"].eqNullSafe(used["_s"]), "left").drop("_s")
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return both.withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("most_uses", F.coalesce("most_uses", F.lit(0))).withColumn("actual_share", F.try_divide(F.col("used_tokens").cast("double"), whole))


def copies(uses: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixture itself: (key, source, copy) with one row for each use of a document."""
    return uses.where("n_uses > 0").select(key, "source", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("copy"))
