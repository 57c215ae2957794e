"""Mixing sources to target weights by weighted fair queueing (operator 6).

Every source is a queue of its documents in shuffled order (by MD5 of the id), sent
again from the start as often as its cap allows.  The weight of a queue is its target.
A document goes out in packets of ``packet`` words at most, and the virtual finish time
of a packet is the words its source has sent by its end, divided by that target.  The
packets of all sources are range-sorted by finish time and cut where their words reach
the total budget; the packet at the cut gives the words that are left.

Words sent before a document are a distributed prefix sum: sums of 4096 hash
buckets of each source first, then inside the buckets, so that a source with a
third of all rows is spread over as many tasks.  The cut adds up whole ranges of the
sorted packets and looks inside one of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import core

#: Fixed by the mix: weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a packet: no source is further from its target than this.
PACKET = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _ranges(df: DataFrame, *order: Column) -> DataFrame:
    """The rows in a table of sorted ranges, with _range: its number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return core.checkpointed(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place of each row in a total order, from 0: ranks inside sorted ranges behind the sizes of the ranges before."""
    ranges = _ranges(df, *order)
    before, ahead = 0, []
    for number, n in sorted((r[0], r[1]) for r in ranges.groupBy("_range").count().collect()):  # one row per range
        ahead.append((number, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(ahead, "_range int, _ahead long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_place", place).join(starts, "_range").withColumn(name, F.col("_place") + F.col("_ahead")).drop("_range", "_place", "_ahead")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: share of all words dealt by weight, no target above cap times its source.

    sizes: source, size.  A target that would be above its cap stays there and the rest is dealt again: the level (words per
    weight) rises from round to round until it takes no other source over its cap.  A round is one sum over the sources.
    """
    by_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "place", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    s = core.checkpointed(by_source.select("source", "source_size", weight.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most")))
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        # most and weight are sums of whole numbers, the same in any order, unless cap has a fraction
        over = F.col("most") < F.lit(level) * F.col("weight")
        n, held, left = s.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n is None or n == capped or not left:
            break
        level, capped = (budget - (held or 0.0)) / left, n
    target = F.least(F.lit(level) * F.col("weight"), F.col("most")) if capped >= 0 and left else F.col("most")
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, packet: int = PACKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words the mix takes of every document.

    Returns id, source, size, source_size, target, taken, start (words its source sends before it in a pass), finish
    (virtual finish time of its first sending) and the columns named in keep, one row per row of docs.  A null text has
    size 0; documents of size 0 give 0 words; a null source is a source of its own, the last; null ids come first in the
    shuffle; rows with equal ids are ordered by size; packets that finish together are ordered by source; texts of any
    length are counted whole; an empty table gives no rows; columns of docs that clash with the added names are read only
    where they are named in keep.  Columns named in keep take no part in the mix: docs is read a second time for them.
    """
    tags = _tags(id_col, source_col, text_col, *keep) if keep else ()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), *tags)
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_order", 1, 3))
    rows = core.checkpointed(rows)
    targets = core.checkpointed(source_targets(rows.select("source", "size"), weights, share, cap))
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("_ahead", ahead).drop("_sum")
    plan = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("_source"), F.col("b._bucket").alias("_b"), "_ahead", "source_size", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", F.col("_id").asc_nulls_first(), "size", *TAGS[: len(tags)]).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    placed = core.checkpointed(placed.withColumn("start", F.col("_ahead") + F.col("_before")).drop("_ahead", "_before", "_bucket", "_b", "_source", "_order"))
    core.discard(rows)
    core.discard(targets)
    sent = _sent(_packets(placed, cap, packet), int(min(share, cap) * words))
    joined = placed.alias("p").join(sent.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source")), "left").select("p.*", F.coalesce("q.sent", F.lit(0)).alias("_sent"))
    one = lambda n: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_sent") - F.col("start") - n * F.col("source_size")))
    taken = sum((one(n) for n in range(1, _passes(cap))), one(0))
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    mixed = joined.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", finish.alias("finish"), *TAGS[: len(tags)])
    return _with_kept(mixed, docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], *tags), keep) if keep else mixed


#: 128 bits of hash that lead from a row of the mix to the row of docs it stands for.
TAGS = ("_tag0", "_tag1")


def _tags(*columns: str) -> list[Column]:
    """Equal for rows that are equal in the columns; a null is not the value beside it."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(i), *parts).alias(name) for i, name in enumerate(TAGS)]


def _with_kept(mixed: DataFrame, kept: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """mixed with the columns kept of its rows: of several equal rows of docs, each gets one of their places in the mix."""
    names = [c for c in mixed.columns if c not in TAGS]
    places = mixed.groupBy(*TAGS).agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in names if c != "start"]))).alias("_places"))
    copy = F.row_number().over(Window.partitionBy(*TAGS).orderBy(TAGS[0]))
    one = kept.join(places, list(TAGS)).withColumn("_place", F.element_at("_places", copy))
    return one.select(*[F.col("_place")[c].alias(c) for c in names], *[F.col(f"_keep_{c}").alias(c) for c in keep])


def _passes(cap: float) -> int:
    return int(-(-cap // 1))


def _packets(placed: DataFrame, cap: float, packet: int) -> DataFrame:
    """finish, source, end (words its source has sent by its end), words of every packet of every sending that its cap allows."""
    some = placed.filter("size > 0 and target > 0").select("source", "size", "start", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(_passes(cap) - 1))).alias("n"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))).alias("from")
    cut = some.select("source", "target", "size", (F.col("n") * F.col("source_size") + F.col("start")).alias("base"), F.floor(cap * F.col("source_size")).alias("most"), step)
    first = F.col("base") + F.col("from")
    end = F.least(first + F.least(F.lit(packet).cast("long"), F.col("size") - F.col("from")), F.col("most"))
    return cut.filter(first < F.col("most")).select((end / F.col("target")).alias("finish"), "source", end.alias("end"), (end - first).alias("words"))


def _sent(packets: DataFrame, budget: int) -> DataFrame:
    """source, sent: the words of each source in the packets of the global order up to the budget."""
    order = F.col("finish"), F.col("source").asc_nulls_last(), F.col("end")
    ranges = _ranges(packets, *order)
    before, cut = 0, None
    for number, n in sorted((r[0], r[1]) for r in ranges.groupBy("_range").agg(F.sum("words")).collect()):  # one row per range
        if before + n >= budget:
            cut = number
            break
        before += n
    whole = ranges if cut is None else ranges.filter(F.col("_range") < cut)
    sent = whole.select("source", "words")
    if cut is not None:
        so_far = F.sum("words").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        last = ranges.filter(F.col("_range") == cut).withColumn("so_far", F.coalesce(so_far, F.lit(0)))
        sent = sent.unionByName(last.select("source", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget - before) - F.col("so_far"))).alias("words")))
    out = core.checkpointed(sent.groupBy("source").agg(F.sum("words").alias("sent")))
    core.discard(ranges)
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, 2.0 * source_size AS most FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS pos,
    (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
v AS (SELECT level FROM l WHERE level * weight <= most ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CAST(least(coalesce((SELECT level FROM v) * weight, most), most) AS DOUBLE) AS target FROM l),
q AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d),
x AS (
  SELECT q.source, t.target, n * t.source_size + q.start AS base, q.size, unnest(range(0, q.size, PACKET)) AS f
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source CROSS JOIN range(0, 2) passes(n) WHERE t.target > 0),
p AS (SELECT source, target, base + f + least(PACKET, size - f) AS last, least(PACKET, size - f) AS words FROM x),
o AS (SELECT source, words, sum(words) OVER (ORDER BY CAST(last AS DOUBLE) / target, source NULLS LAST, last ROWS UNBOUNDED PRECEDING) - words AS so_far FROM p),
z AS (SELECT source, CAST(sum(greatest(0, least(words, (SELECT floor(1.5 * sum(source_size)) FROM s) - so_far))) AS BIGINT) AS sent FROM o GROUP BY source)
SELECT q.doc_id, q.size, t.source_size, t.target,
  CAST(greatest(0, least(q.size, coalesce(z.sent, 0) - q.start)) + greatest(0, least(q.size, coalesce(z.sent, 0) - q.start - t.source_size)) AS BIGINT) AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON q.source IS NOT DISTINCT FROM z.source
""".replace("PACKET", str(PACKET))
