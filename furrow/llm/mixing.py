"""Mixing sources to target weights with exact word budgets.

Every document gets a hash-random key.  Within a source the documents are in key
order, dealt to equal key ranges; prefix sums over the ranges' word totals find the range in
which a source's budget ends, and only that range is sorted to find the document
and the word of the cut.  A budget beyond the source's size repeats whole epochs first.
All work is DataFrame expressions; one row per source decides for all its documents,
so a source of any size is spread over all tasks.

Targets: sources in code point order, a null source last, take weights from a repeating
cycle and share the total; none gets more than ``cap`` times its size, the rest being
shared anew by weight.

Defined cases: a null or blank text has size 0; a null id orders by its text; rows that
are alike in id and size share the words left at the cut evenly (rounded down); a source
without words has target 0; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Place between a word and the blank after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
KEY_BITS = 60
#: Documents that one key range holds on average, over all sources.
RANGE_ROWS = 8192
#: Source rows up to which the per-source cuts are broadcast; beyond it the join is left to Spark.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """Hash-random key of a document, 60 bits of the MD5 of its id (its text if it has none)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, its null-safe name, size and key of every row."""
    return docs.select("doc_id", "source", source_name(F.col("source")).alias("name"), word_count(F.col("text")).alias("size"),
                       mix_key(F.col("doc_id"), F.col("text")).alias("key"))


def source_name(source: Column) -> Column:
    """A source as a join key: never null, the null source apart from all others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """name, source_size, target from (source, name, source_size), one row per source.

    Sources are capped in the order of cap * size / weight; the first that need
    not be capped fixes the level for all after it, which is what repeated resharing ends in.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    limits = ranked.select("name", F.col("source_size"), F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1)).cast("double").alias("weight"),
                           (F.col("source_size") * cap).cast("double").alias("limit"), "rank")
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = limits.withColumns({
        "total": F.sum(F.col("source_size").cast("double")).over(every), "weights": F.sum("weight").over(every),
        "limits_before": F.coalesce(F.sum("limit").over(order), F.lit(0.0)), "weights_before": F.coalesce(F.sum("weight").over(order), F.lit(0.0))})
    capped = level.withColumn("capped", F.col("limit") * (F.col("weights") - F.col("weights_before")) <= F.col("weight") * (F.col("total") - F.col("limits_before")))
    left = capped.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(every), F.lit(0.0)),
        "rest_weight": F.col("weights") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0.0))})
    return left.select("name", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * F.col("rest") / F.col("rest_weight")).alias("target"))


def place() -> Column:
    """Order of documents within a source."""
    return F.struct("key", "doc_id", "size")


def cuts(rows: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: target, whole epochs, and the document at which the last epoch ends with its words.

    ``rows`` is ``sized`` documents, kept by the caller since it is read more than once.
    """
    count = rows.count()
    shift = KEY_BITS - max(1, (max(count, 1) // RANGE_ROWS).bit_length())
    ranged = rows.withColumn("range", F.shiftright("key", shift))
    totals = checkpointed(ranged.groupBy("name", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    goals = targets(totals.groupBy("name").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), cycle, cap)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (totals.withColumn("before", before).join(goals.select("name", "rest"), "name")
            .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("name", "range", "before", "rest"))
    near = ranged.join(last, ["name", "range"])
    upto = F.sum("size").over(Window.partitionBy("name").orderBy("key", "doc_id", "size"))
    alike = F.count("*").over(Window.partitionBy("name", "key", "doc_id", "size"))
    tied = near.withColumns({"upto": F.col("before") + upto, "alike": alike}).withColumn("start", F.col("upto") - F.col("alike") * F.col("size"))
    end = (tied.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
           .groupBy("name").agg(F.min(place()).alias("cut"), F.min(F.floor((F.col("rest") - F.col("start")) / F.col("alike")).cast("long")).alias("cut_words")))
    found = checkpointed(goals.join(end, "name", "left").select("name", "source_size", "target", "epochs", "cut", "cut_words"))
    return F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found


def taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, whole epochs, the words of the last epoch (part), and all words taken."""
    part = F.when(place() < F.col("cut"), F.col("size")).when(place() == F.col("cut"), F.col("cut_words")).otherwise(F.lit(0).cast("long"))
    return (rows.join(ends, "name").withColumn("part", F.when(F.col("cut").isNull(), F.lit(0).cast("long")).otherwise(part))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop("cut", "cut_words"))


def mix_plan(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, epochs, part, taken of every document."""
    rows = checkpointed(sized(docs))
    return taken(rows, cuts(rows, cycle, cap)).select("doc_id", "size", "source_size", "target", "epochs", "part", "taken")


def mixed_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per epoch of a document that is in it.

    The document at a source's cut appears in its last epoch with the text up to
    the last word that the budget pays for.  Documents without words are in no mix.
    """
    rows = sized(docs)
    ends = cuts(checkpointed(rows), cycle, cap)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", source_name(F.col("source")).alias("name"),
                        word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("key"))
    planned = taken(whole, ends)
    full = F.array_repeat(F.col("size"), (F.col("epochs") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("int"))
    some = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array("part")).otherwise(F.array().cast("array<bigint>"))
    repeats = planned.filter("taken > 0").withColumn("words", F.explode(F.concat(full, some)))
    cut_text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(F.split("row.text", WORD_END), 1, F.col("words").cast("int")), ""))
    return repeats.withColumn("cut_text", cut_text).select(*[F.col("cut_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


#: The same plan in DuckDB's SQL, over all documents at once.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
limits AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS lim FROM sizes),
level AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(lim) OVER before, 0) AS limits_before, coalesce(sum(weight) OVER before, 0) AS weights_before
  FROM limits
  WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, lim * (weights - weights_before) <= weight * (total - limits_before) AS capped FROM level),
goals AS (
  SELECT source, source_size,
         CASE WHEN capped THEN lim ELSE weight * (total - coalesce(sum(CASE WHEN capped THEN lim END) OVER (), 0))
              / (weights - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0)) END AS target
  FROM capped),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM goals),
ordered AS (
  SELECT rows.*, b.source_size, b.target, b.epochs, CAST(floor(b.target + 0.5) AS BIGINT) - b.epochs * b.source_size AS rest,
         sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         count(*) OVER (PARTITION BY rows.source, key, doc_id, size) AS alike
  FROM rows JOIN budgets b ON rows.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs AS BIGINT) AS epochs,
       CAST(greatest(0, least(size, (rest - (upto - alike * size)) // alike)) AS BIGINT) AS part,
       CAST(epochs * size + greatest(0, least(size, (rest - (upto - alike * size)) // alike)) AS BIGINT) AS taken
FROM ordered
"""
