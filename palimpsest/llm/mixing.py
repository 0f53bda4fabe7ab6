"""Mixing sources to target weights by a low-discrepancy schedule.

Targets.  Sources in code-point order (null last) get the weights in turn, and share
``total_percent`` of all words; a target stops at ``most`` times its source's size and the
excess goes to the others by weight, until none is above (``targets``).

Schedule.  Each source's documents are shuffled (a hash of the id) and laid end to end,
again and again, on an axis of words that is cut into blocks of equal length.  Slot j of
the mix is the golden-ratio point frac((j + 1) * phi); mapped through the cumulative
weights it names a source, and the slots of a source take its blocks in order, so that any
stretch of the mix has the target shares up to a few blocks.  A source takes blocks up to
its target, and its further slots stay empty; blocks that the schedule leaves open get the
slots after its end, by source.  Slots and blocks meet in an equi-join on (source, block),
whose result is the mix (``mixed_documents``); the words taken of each document, the slot in
which it comes first and the number of its slots are aggregates of it (``take``).

Scale.  Every running sum goes through buckets (a hash or number range), so no window holds
more than a bucket of a source; blocks spread a hot source over many join keys; the
schedule meets the cumulative weights through a bucketed interval join.  Sources are never
collected: the water-filling is a few aggregates over the table of sources.

Defined results: a null text has size 0 and is taken 0 words; null sources are a source of
their own; rows with equal ids are separate documents; null ids too, shuffled by their texts;
without words all targets are 0 and the mix is empty; what the mix does not take has no
first slot; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

WEIGHTS = (3, 1, 2)
BUCKETS = 4096
SLOTS = 100_000  # blocks in a mix, about
PHI = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group before this one, in the order of bucket, then ``order``."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("in_bucket"))
    before = F.expr(f"coalesce(sum(in_bucket) over (partition by `{group}` order by `{bucket}` rows between unbounded preceding and 1 preceding), 0)")
    sums = sums.select(F.col(group).alias("g_"), F.col(bucket).alias("b_"), before.alias("before_"))
    own = F.expr(f"coalesce(sum(`{value}`) over (partition by `{group}`, `{bucket}` order by {', '.join(order)} rows between unbounded preceding and 1 preceding), 0)")
    joined = df.withColumn("own_", own).join(sums, F.col(group).eqNullSafe(F.col("g_")) & (F.col(bucket) == F.col("b_")))
    return joined.withColumn(name, F.col("before_") + F.col("own_")).drop("g_", "b_", "before_", "own_")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, sid, weight, target) from (source, source_size); sid numbers the sources from 0."""
    # Numbering: ranges of sources, counted, then numbered inside.
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    ranged = sizes.withColumn("all", F.lit(0)).withColumn("key", key).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1))
    ranged = running(materialize(ranged, "sources"), "all", "part", ["key"], "one", "sid")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(ranged.select("source", "source_size", F.col("sid").cast("long").alias("sid"), F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")).alias("weight")), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * total_percent / 100
    cap = F.col("source_size") * float(most)
    level, full = 0.0, -1
    while True:  # the level rises until no further source is full; each turn fills one at least
        is_full = F.col("weight") * level >= cap
        n, held, rest = table.agg(F.sum(F.when(is_full, 1).otherwise(0)), F.sum(F.when(is_full, cap).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (total - held) / rest
    return table.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap))


def dealt(plan: DataFrame, block: int, total: float) -> DataFrame:
    """(sid, block, slot, words) of every block that a source takes up to its target of ``words``; no two have a slot in common."""
    need = plan.select("sid", F.round("target").cast("long").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block))
    n = int(total // block) + 1
    mix = schedule(plan, total, n)
    rank = materialize(running(mix.withColumn("one", F.lit(1)), "sid", "chunk", ["slot"], "one", "rank"), "ranks")
    used = rank.join(need, "sid").where("rank < blocks").select("sid", F.col("rank").cast("long").alias("block"), "slot", "words")
    reached = rank.groupBy("sid").agg(F.count("*").alias("n"))
    late = need.join(reached, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks").withColumn("open", F.col("blocks") - F.col("n"))
    late = running(late.withColumn("all", F.lit(0)).withColumn("part", F.floor(F.col("sid") / 1000)), "all", "part", ["sid"], "open", "before")
    late = late.select("sid", F.explode(F.expr("sequence(n, blocks - 1)")).alias("block"), "n", "before", "words")
    return used.union(late.select("sid", "block", (F.lit(n) + F.col("before") + F.col("block") - F.col("n")).alias("slot"), "words"))


def laid_and_mixed(docs: DataFrame, weights: tuple[int, ...], total_percent: int, most: int, id_col: str, text_col: str, source_col: str, slots: int) -> tuple[DataFrame, DataFrame]:
    """Every document on its source's axis, and the mix."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("seed"))
    sized = materialize(sized.withColumn("h", F.when(F.col("doc_id").isNull(), F.col("seed")).otherwise(F.xxhash64("doc_id", F.lit("mix")))).drop("seed").withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int")), "sized")
    plan = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_percent, most), "targets")
    laid = running(sized, "source", "bucket", ["h", "doc_id", "size"], "size", "start")
    laid = materialize(laid.join(plan, laid["source"].eqNullSafe(plan["source"])).select("doc_id", plan["source"], "size", "sid", "source_size", "target", "start").withColumn("row", F.monotonically_increasing_id()), "laid")
    total = float(plan.agg(F.sum("target")).first()[0] or 0)
    block = max(1, int(total / slots))

    # Every document on the axis, once for each time round, with the blocks it lies in.
    turns = laid.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("lo", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("hi", F.col("lo") + F.col("size"))
    pieces = turns.select("row", "doc_id", "source", "sid", "lo", "hi", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")).alias("block"))
    begin = F.greatest(F.col("lo"), F.col("block") * block)
    end = F.least(F.col("hi"), (F.col("block") + 1) * block, F.col("words"))
    mixed = pieces.join(dealt(plan, block, total), ["sid", "block"]).where(end > begin)
    return laid, materialize(mixed.select("slot", "source", "block", (begin - F.col("block") * block).alias("place"), "row", "doc_id", (begin - F.col("lo")).alias("first_word"), (end - begin).alias("n_words")), "mix")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS) -> DataFrame:
    """The mix: (slot, source, block, place, row, doc_id, first_word, n_words), which is read in the order of slot and place.

    Each row is a stretch of words of one document, from ``first_word`` (0 is the document's first) on; ``block`` counts along
    the source's axis, ``place`` words inside the block. A document that is taken twice has stretches in both times round.
    """
    return laid_and_mixed(docs, weights, total_percent, most, id_col, text_col, source_col, slots)[1]


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, first_slot, slots) of each row, from the mix; row tells equal ids apart."""
    laid, mixed = laid_and_mixed(docs, weights, total_percent, most, id_col, text_col, source_col, slots)
    got = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.countDistinct("slot").alias("slots"))
    return laid.join(got, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).alias("slots"))


def schedule(plan: DataFrame, total: float, n: int) -> DataFrame:
    """(slot, sid, chunk) of n slots: golden-ratio points through the cumulative targets."""
    spark = plan.sparkSession
    if total <= 0:
        return spark.createDataFrame([], "slot long, sid long, chunk long")
    grid = 1024
    parts = running(plan.withColumn("all", F.lit(0)).withColumn("part", F.floor(F.col("sid") / 1000)), "all", "part", ["sid"], "target", "from")
    ends = parts.select("sid", (F.col("from") / total).alias("lo"), ((F.col("from") + F.col("target")) / total).alias("hi")).where("hi > lo")
    cells = ends.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1)))).alias("cell"))
    u = (F.col("id") + 1) * PHI
    points = spark.range(n).select(F.col("id").alias("slot"), (u - F.floor(u)).alias("u")).withColumn("cell", F.floor(F.col("u") * grid))
    return points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.floor(F.col("slot") / 65536).alias("chunk"))
