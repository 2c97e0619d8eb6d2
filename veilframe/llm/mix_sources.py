"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) take the weights in turn and share
all words; a source's target stops at ``max_repeat`` times its words and the
rest is shared again by weight (water filling, by sums over the table of
sources until no more of them stop). Within a source every document expects
``target / size`` copies. Documents stand in order of size, so a prefix sum
of expected copies plus one random offset crosses an integer once for every
copy, and the words taken stay within one document's size of the target.

Prefix sums are distributed: rows are range-partitioned by (source, size,
doc_id), so a hot source spans many partitions, and only the count of each
source in each partition is summed over partitions.

Defined cases: null or empty text has size 0; a source of size 0 takes
nothing; a null source is a source of its own; rows with equal doc_id, source
and size are told apart by a hash of the text, and are equal for sampling
beyond that; an empty table gives no rows. Other columns are carried by
``mixed_documents`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 20
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(ranged: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target of rows (source, size, at), where ``at``
    numbers the rows in order of source: part above 33 bits, row below."""
    per = ranged.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("at").alias("first"))
    per = materialise(per.withColumn("s_part", F.shiftright("first", 33)), "sources")
    # places of sources: within the part where each begins, after all earlier parts
    starts = per.groupBy("s_part").agg(F.count(F.lit(1)).alias("starts"))  # one row a part
    starts = starts.select(F.col("s_part").alias("b_part"), (F.sum("starts").over(W.orderBy("s_part")) - F.col("starts")).alias("earlier"))
    place = F.col("earlier") + F.row_number().over(W.partitionBy("s_part").orderBy("first")) - 1
    per = per.join(starts, F.col("s_part") == F.col("b_part")).withColumn("place", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_repeat))).alias("cap"))
    # the words of one unit of weight: sources that stop at their cap leave
    # the rest to the others, until no more of them stop
    total, level, stopped = float(per.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        stops = F.col("cap") < F.lit(level) * F.col("weight")
        got = per.agg(F.count(F.when(stops, 1)), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if got[0] == stopped or not got[2]:
            break
        stopped, level = got[0], (total - (got[1] or 0.0)) / got[2]
    return per.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _copies(slim: DataFrame, weights, max_repeat: int, seed: int) -> DataFrame:
    """Adds source_size, target and copies to rows (doc_id, source, size,
    order, ...); ``order`` tells rows apart that agree in the first three."""
    keys = [F.col("source").asc_nulls_last(), "size", "doc_id"]
    ranged = slim.repartitionByRange(*keys).sortWithinPartitions(*keys, "order").drop("order")
    ranged = materialise(ranged.select("*", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "mix")
    targets = source_targets(ranged, weights, max_repeat)
    runs = ranged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    runs = runs.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n"))
    runs = runs.join(targets, runs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    r = runs.select(F.col("part").alias("r_part"), F.col("source").alias("r_source"), "before", "first", "source_size", "target")
    rows = ranged.join(r, (F.col("part") == F.col("r_part")) & F.col("source").eqNullSafe(F.col("r_source")))
    rank = F.col("before") + F.col("at") - F.col("first") + 1
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("offset", offset).withColumn("rank", rank).withColumn("part_copy", F.col("rate") - F.floor("rate"))
    # every other unit of the prefix sum is walked backwards, so that taking
    # the smaller document in one unit is made good in the next
    unit = F.floor((F.col("rank") - 1) * F.col("part_copy"))
    back = F.ceil(unit / F.col("part_copy")) + 1 + F.ceil((unit + 1) / F.col("part_copy")) - F.col("rank")
    rows = rows.withColumn("place", F.when((F.col("part_copy") > 0) & (unit % 2 == 1), back).otherwise(F.col("rank")))
    crossed = lambda k: F.floor(k.cast("double") * F.col("part_copy") + F.col("offset"))
    copies = F.floor("rate") + crossed(F.col("place")) - crossed(F.col("place") - 1)
    return rows.select(*[c for c in slim.columns if c != "order"], "source_size", "target", copies.cast("long").alias("copies"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.xxhash64(text).alias("order"), *more)


def sample_copies(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row."""
    return _copies(_slim(docs, id_col, text_col, source_col), weights, max_repeat, seed)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to
    ``max_repeat`` times). A row travels as one value, so columns of any name
    and rows that differ in any column keep what they hold."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = _copies(_slim(docs, id_col, text_col, source_col, whole), weights, max_repeat, seed).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sample_copies(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, ((i - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('20:' || coalesce(t.source, 'null')), 1, 8))::BIGINT / 4294967296.0 AS off,
  row_number() OVER (PARTITION BY t.source ORDER BY d.size, d.doc_id) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, rate - floor(rate) AS f FROM r),
q AS (SELECT *, CASE WHEN f > 0 AND floor((k - 1) * f)::BIGINT % 2 = 1
  THEN ceil(floor((k - 1) * f) / f) + 1 + ceil((floor((k - 1) * f) + 1) / f) - k ELSE k END AS place FROM p)
SELECT doc_id, size, source_size, target, (floor(rate) + floor(place * f + off) - floor((place - 1) * f + off))::BIGINT * size AS taken FROM q
"""
