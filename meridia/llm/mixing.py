"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Each source's documents are shuffled (by the MD5 of their id) into one stream of words and cut into blocks of equally many
words. A schedule deals slots: the i-th van der Corput point falls into one source's part of the cumulative weights, and
the slots of a source are ranked; the r-th slot takes block r of the stream, from its start again after each epoch. The
last slot is cut so that a source gives as many words as its target, rounded.

Cases: null text has no words; null source is a source of its own; documents without words are never taken and keep their
row; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._rank import running_total
from meridia.llm._store import fresh, tasks, written

WORD = r"[^\x20\x09-\x0D]+"
#: Cells in which points are looked up, and slots that are ranked together.
CELLS, RANKED = 4096, 65536


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def van_der_corput(i: Column) -> Column:
    """The bits of i mirrored at the binary point, in [0, 1); i below 2**53."""
    x = i.cast("long")
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(m), step).bitwiseOR(F.shiftrightunsigned(x, step).bitwiseAND(m))
    return F.shiftrightunsigned(x, 11).cast("double") / F.lit(float(1 << 53))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, text_hash, source, key, size, place) of each document; key is the source, never null, place its order."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
        n_words(text).alias("size"),
        F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit("")).alias("place"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, key, source_size, target) by source, of all rows of sized().

    Sources by code point, null last, have the weights in turn and share all words; a target above `most` times its
    source's size stops there and the rest is shared by weight: target = least(cap, level * weight), where the level is
    found by sorting the sources by the level that fills them.
    """
    by = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", F.col("source_size") * most).withColumn("fills", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    by = by.withColumn("level", F.min_by(F.when(F.col("fills") >= F.col("level"), F.col("level")), F.when(F.col("fills") >= F.col("level"), F.col("fills"))).over(whole))
    return by.select("source", "key", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(goals: DataFrame, block_words: int) -> DataFrame:
    """(slot, key, rank, block, words): the slots in order, with the block that each takes and how many of its words.

    goals: of targets(). A source whose points fall short of its slots, by the sequence's discrepancy, gets the rest last.
    """
    spark = goals.sparkSession
    wants = goals.withColumn("words", F.least(F.round("target").cast("long"), 3 * F.col("source_size")))
    size, words = F.col("source_size"), F.col("words")
    wants = wants.filter(words > 0).select(
        "key",
        F.ceil(size / block_words).alias("per_epoch"),
        F.floor(words / size).alias("epochs"),
        (words % size).alias("rest"),
    )
    wants = wants.withColumn("slots", F.col("epochs") * F.col("per_epoch") + F.ceil(F.col("rest") / block_words))
    up_to = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wants = wants.withColumn("_all", F.sum("slots").over(whole)).withColumn("_to", F.sum("slots").over(up_to) / F.col("_all"))
    wants = wants.withColumn("_from", (F.sum("slots").over(up_to) - F.col("slots")) / F.col("_all"))
    wants = written(wants, free=False)
    n = wants.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    points = spark.range(n).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS))
    cells = wants.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1)))))
    dealt = points.join(cells.select("key", "_cell", "_from", "_to"), "_cell").filter((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    dealt = dealt.select("slot", "key", F.floor(F.col("slot") / RANKED).alias("_piece"))
    dealt = running_total(dealt, "key", "_piece", ["slot"], F.lit(1), "rank").drop("_piece")
    counts = dealt.groupBy("key").agg(F.count("*").alias("_n"))
    short = wants.join(counts, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_n") < F.col("slots"))
    late = short.select("key", F.explode(F.sequence("_n", F.col("slots") - 1)).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "key", "rank")
    ranked = dealt.select("slot", "key", "rank").unionByName(late).join(wants.select("key", "per_epoch", "slots", "rest"), "key").filter(F.col("rank") < F.col("slots"))
    cut = F.col("rest") % block_words
    last = (F.col("rank") == F.col("slots") - 1) & (cut > 0)
    return ranked.select("slot", "key", "rank", (F.col("rank") % F.col("per_epoch")).alias("block"), F.when(last, cut).otherwise(F.lit(block_words)).cast("long").alias("words"))


def _placed(docs: DataFrame, block_words: int, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents of sized(), the sources' targets, the slots, and the pieces (row, key, block, _head, _a, _b) that the
    documents' words make of their blocks: words _a to _b of the block; _head tells whether the first one begins the document.
    """
    sizes = written(sized(docs, doc_id, text, source), free=False)
    goals = written(targets(sizes), free=False)
    placed = running_total(sizes.withColumn("_piece", F.substring("place", 1, 2)), "key", "_piece", ["place", "doc_id", "size", "row"], F.col("size"), "begin")
    end = F.col("begin") + F.col("size")
    pieces = placed.filter(F.col("size") > 0).select(
        "row", "doc_id", "text_hash", "key", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))).alias("block")
    )
    a, b = F.greatest("begin", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    pieces = pieces.select("row", "doc_id", "text_hash", "key", "block", (F.col("begin") == a).alias("_head"), (a - F.col("block") * block_words).alias("_a"), (b - F.col("block") * block_words).alias("_b"))
    return sizes, goals, schedule(goals, block_words), pieces


def mix(docs: DataFrame, block_words: int = 8192, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, text_hash, size, source_size, target, taken, first_slot): how many words the mix takes of each document.

    taken counts repeats and never exceeds three times the size; first_slot is the first slot that takes a word of it.
    """
    sizes, goals, slots, pieces = _placed(docs, block_words, doc_id, text, source)
    taken = F.least("_b", "words") - F.col("_a")
    got = (
        pieces.join(slots.select("key", "block", "slot", "words"), ["key", "block"])
        .filter(taken > 0)
        .groupBy("row")
        .agg(F.sum(taken).alias("taken"), F.min("slot").alias("first_slot"))
    )
    return (
        sizes.join(goals.select("key", "source_size", "target"), "key")
        .join(got, "row", "left")
        .select("row", "doc_id", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")
    )


def mixed(docs: DataFrame, block_words: int = 8192, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the documents' own columns: each whole document as often as its first word is taken, in the order
    of the slots that take it.

    Rows that are equal in id and text share their places; one of them stands for all.
    """
    _, _, slots, pieces = _placed(docs, block_words, doc_id, text, source)
    own, one, at, slot = (fresh(docs, x) for x in ("own", "one", "at", "slot"))
    heads = pieces.filter("_head").join(slots.select("key", "block", "slot", "words"), ["key", "block"]).filter(F.col("words") > F.col("_a"))
    places = heads.select(F.xxhash64("doc_id", "text_hash").alias(own), F.col("slot").alias(slot), F.col("_a").alias(at))
    once = Window.partitionBy(own).orderBy(F.lit(1))
    rows = docs.withColumn(own, F.xxhash64(F.col(doc_id), F.xxhash64(text))).withColumn(one, F.row_number().over(once)).filter(F.col(one) == 1)
    return rows.join(places, own).repartitionByRange(tasks(docs.sparkSession), slot, at, own).sortWithinPartitions(slot, at, own).drop(own, one, at, slot)


#: The rows of mix() for a table `documents`: levels by trying each number of full sources, slots from the bits of their
#: numbers, and what each slot takes of each document.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
t AS (SELECT w.cap / w.weight AS tried FROM w UNION SELECT 0),
f AS (SELECT tried, (SELECT sum(source_size) FROM w) AS whole, sum(cap) FILTER (cap / weight <= tried) AS full_caps, sum(weight) FILTER (cap / weight > tried) AS open_weight FROM t, w GROUP BY tried),
l AS (SELECT max(((whole - coalesce(full_caps, 0)) / open_weight)::DOUBLE) FILTER ((whole - coalesce(full_caps, 0)) / open_weight >= tried) AS level FROM f),
g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(l.level, 0) * weight) AS target, 3 * source_size AS most FROM w, l),
h AS (SELECT *, least(round(target)::BIGINT, most) AS words FROM g),
n AS (SELECT *, (source_size + BLOCK - 1) // BLOCK AS per_epoch, words % source_size AS rest, (words // source_size) * ((source_size + BLOCK - 1) // BLOCK) + (words % source_size + BLOCK - 1) // BLOCK AS slots FROM h WHERE words > 0),
c AS (SELECT *, sum(slots) OVER (ORDER BY coalesce('=' || source, '')) AS upto, sum(slots) OVER () AS every FROM n),
p AS (SELECT i, sum(((i >> k) & 1) / 2.0::DOUBLE ** (k + 1)) AS u FROM range(0, (SELECT coalesce(max(every), 0)::BIGINT FROM c)) r(i), range(0, 40) z(k) GROUP BY i),
e AS (SELECT c.source, c.slots, c.per_epoch, c.rest, i AS slot, row_number() OVER (PARTITION BY c.source ORDER BY i) - 1 AS rank FROM p JOIN c ON u >= (upto - slots) / every AND u < upto / every),
k AS (SELECT source, slots, per_epoch, rest, slot, rank FROM e WHERE rank < slots
      UNION ALL SELECT c.source, c.slots, per_epoch, rest, every + r.rank, r.rank FROM c JOIN range(0, 1000000) r(rank) ON r.rank < slots
      AND r.rank >= (SELECT count(*) FROM e WHERE e.source IS NOT DISTINCT FROM c.source)),
b AS (SELECT source, slot, (rank % per_epoch) * BLOCK AS x, (rank % per_epoch) * BLOCK + CASE WHEN rank = slots - 1 AND rest % BLOCK > 0 THEN rest % BLOCK ELSE BLOCK END AS y FROM k),
o AS (SELECT d.*, row_number() OVER () AS row, coalesce(sum(size) OVER (PARTITION BY source ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d)
SELECT any_value(o.doc_id) AS doc_id, any_value(o.size) AS size, any_value(h.source_size) AS source_size, any_value(h.target) AS target,
  coalesce(sum(least(a + size, y) - greatest(a, x)) FILTER (slot IS NOT NULL), 0)::BIGINT AS taken, min(slot)::BIGINT AS first_slot
FROM o JOIN h ON o.source IS NOT DISTINCT FROM h.source LEFT JOIN b ON o.source IS NOT DISTINCT FROM b.source AND least(a + size, y) > greatest(a, x)
GROUP BY o.row
""".replace("BLOCK", "8192")
