"""Problem 7: documents of several sources mixed to target shares of tokens.

Systematic sampling within a source: documents stand in the order of their size, each with the same expected number of
copies; the prefix sum of those, plus one random offset, crosses an integer boundary once for every copy that is emitted. Standing by
size, equal stretches hold equal tokens, so the share is met closely. Positions within a source come from a range partition, so no
source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.functions.hashing import hash60
from flowloom.llm.bpe import token_lengths
from flowloom.operators.skew import ordinals
from flowloom.session import materialize

SEED = 20260922


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, key, n_tokens, order): documents with their source's key and size in tokens."""
    docs = documents.select(F.col("text").cast("string"), F.col("doc_id").cast("bigint").alias("doc_id"), canon.word_key("source").alias("key"))
    order = hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), SEED)
    return materialize(token_lengths(docs).withColumn("order", order), "sized")


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The target table with the wanted tokens, the tokens there are, and the expected copies of each document of a source.

    Expected copies are at most max_repeats; a source that cannot give its share at that is marked capped, and its
    share is not given to others. Sources are summed before they meet the targets, so that this is a table of the targets' size.
    """
    have = sized.groupBy("key").agg(F.sum("n_tokens").alias("available"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    wanted = F.col("target_share") * F.col("size_ratio") * F.lit(total)
    t = targets.withColumn("key", canon.word_key("source")).join(have, "key", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("wanted", wanted)
    rate = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return t.withColumn("rate", rate).withColumn("capped", F.col("available") * F.col("max_repeats") < F.col("wanted"))


def mix(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mix_id, source, doc_id, copy_no, n_tokens) of every copy, and the report of what each mix reached.

    targets: mix_id, source, target_share, max_repeats, size_ratio; a small table. Sources are compared by letters and digits. Documents of no
    or unnamed source are in no mix but count for the size of all; those without tokens (null, empty) are left out. No document is used more
    often than max_repeats. Same on every run and partitioning. Repeated doc_ids are documents of their own.
    """
    sized = sized_documents(documents)
    plan = materialize(rates(sized, targets), "rates")  # as many rows as targets
    placed = ordinals(sized.where("n_tokens > 0 AND key IS NOT NULL"), ["key"], ["n_tokens", "order", "doc_id"], "place")
    offset = hash60(F.concat_ws("|", "mix_id", "key"), SEED) / float(1 << 60)
    # Rounding to a millionth of a copy first keeps whole rates whole, whatever the prefix sum's last digits.
    upto = lambda n: F.floor(F.round(n * F.col("rate") + offset, 6))
    small = F.broadcast(plan.where("rate > 0").select("mix_id", "source", "key", "rate"))
    copies = placed.join(small, "key").withColumn("copies", (upto(F.col("place") + 1) - upto(F.col("place"))).cast("int")).where("copies > 0")
    copies = materialize(copies.select("mix_id", "source", "key", "doc_id", "n_tokens", "copies"), "copies")
    rows = copies.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    got = copies.groupBy("mix_id", "key").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = plan.join(got, ["mix_id", "key"], "left").join(whole, "mix_id", "left")
    share = F.when(F.col("mix_tokens") > 0, F.round(F.coalesce("tokens", F.lit(0)) / F.col("mix_tokens"), 6))
    return rows, report.select("mix_id", "source", "target_share", share.alias("share"), F.round("wanted").cast("bigint").alias("wanted_tokens"), zero("tokens"), "available", zero("documents"), zero("most_copies"), "max_repeats", "capped")
