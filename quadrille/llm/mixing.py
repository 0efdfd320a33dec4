"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Every source gets a target in words: its share, by weight, of `epochs` times all words, stopped
at `cap` times its own size, the excess reshared by weight among the others. Within a source a
document's expected copies grow with its length class (the binary digits of its size): they are
min(cap, level x class), with the level at which they add up to the target. The whole copies are
allocated for certain. What is left over of a document's expected copies is its inclusion probability
p for one copy more, and its rank is (u / (1 - u)) / (p / (1 - p)) with u uniform; the lowest ranks whose
words add up nearest to what is left of the target are taken. The sample's size is fixed in words, so
a source misses its target by half a document at most.

u comes from the md5 of the document's id (of its text if it has none), so reruns agree. No source is
sorted whole: words are added up by source and bins of the rank, twice, and only a bin of a bin, with the cut,
is ordered. What is decided of a source is one row of fixed width, the last rank included; each document then
finds its copies from that row alone, so texts are not shuffled. One row per source passes through a
single task; it is sorted with spilling.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
an empty text is taken 0 words; rows with the same id and size share a rank and stand together, of
which the first ones by text hash are taken if the cut falls among them; no words at all give targets
of 0; empty tables give empty tables; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, checkpointed, quoted, table

BINS = 4096
#: Sources up to which their table is broadcast (about 200 bytes each); beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number between 0 and 1 from the md5 of the key; null counts as empty."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def length_class(size: Column) -> Column:
    """The binary digits of the size, 1 at least."""
    return F.length(F.bin(size)).cast("long")


def described(docs: DataFrame) -> list[Column]:
    """id, source, size and u of documents (doc_id, source, text)."""
    return [F.col("doc_id").alias("id"), F.col("source"), word_count(F.col("text")).alias("size"), uniform(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).alias("u")]


def source_targets(sizes: DataFrame, weights: list[int], epochs: float, cap: int) -> DataFrame:
    """From rows (source, size): source, source_size and target."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("room", F.col("most").cast("double") / F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum("most").over(earlier), F.lit(0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) * epochs - F.col("spent")) / F.col("left"))
        .withColumn("place", F.row_number().over(by_room))
        # Up to the first source that is not capped, the level at each source takes all before it as capped.
        .withColumn("level", F.min(F.when(F.col("level") < F.col("room"), F.struct("place", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double")))
        .select("source", "source_size", "target")
    )


def source_levels(sizes: DataFrame, weights: list[int], epochs: float, cap: int) -> DataFrame:
    """source, source_size, target, level (null: cap copies of every document) and rest, the words left after the whole copies. Checkpointed."""
    classes = checkpointed(sizes.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("size")))
    targets = source_targets(classes, weights, epochs, cap).withColumnRenamed("source", "_source")
    longest = Window.partitionBy("source").orderBy(F.desc("class"))
    earlier, onward = longest.rowsBetween(Window.unboundedPreceding, -1), longest.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("target") - cap * F.coalesce(F.sum("size").over(earlier), F.lit(0))) / F.sum(F.col("class") * F.col("size")).over(onward)
    # The level at each class takes all longer ones as capped; the first that stays below the cap itself is right.
    known = (
        classes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("level", F.when(F.sum("size").over(onward) > 0, level))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("class") <= cap, F.struct((-F.col("class")).alias("place"), "level"))).over(Window.partitionBy("source"))["level"])
        .withColumn("whole", F.floor(expected_copies(F.col("class"), cap)).cast("long") * F.col("size"))
    )
    rest = F.col("target") - F.sum("whole")
    return checkpointed(known.groupBy("source", "source_size", "target", "level").agg(rest.alias("rest")))


def expected_copies(length: Column, cap: int) -> Column:
    return F.coalesce(F.least(F.lit(float(cap)), F.col("level") * length), F.lit(float(cap)))


def _with_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of their source."""
    sources = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _ranked(rows: DataFrame, sources: DataFrame, cap: int, small: bool) -> DataFrame:
    """rows (id, source, size, u) with those of their source, the certain copies, and `mark`: (rank, id, size) if there may be one more."""
    share = expected_copies(length_class(F.col("size")), cap)
    u, p = F.col("u"), F.col("p")
    rank = (u / (1 - u)) / (p / (1 - p))
    found = _with_sources(rows, sources, small).withColumn("whole", F.floor(share).cast("long")).withColumn("p", share - F.floor(share))
    return found.withColumn("mark", F.when((p > 0) & (p < 1), F.struct(rank.alias("rank"), "id", "size")))


def _first_above(words: DataFrame, place: str) -> DataFrame:
    """(source, at, before): of rows (source, place, words, rest, before), the first place by which the words exceed the rest, and the words before it."""
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy(place))
    above = words.withColumn("upto", upto).where("upto > rest")
    return above.groupBy("source").agg(F.min(F.struct(F.col(place).alias("at"), (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("cut")).select("source", "cut.*")


def plan_sources(sizes: DataFrame, weights: list[int], epochs: float, cap: int) -> DataFrame:
    """For each source: source_size, target, level, the mark at the cut, and how many of the rows with this mark are taken. Checkpointed.

    sizes: checkpointed rows (id, source, size, u).
    """
    sources = source_levels(sizes, weights, epochs, cap)
    small = sources.count() <= BROADCAST_SOURCES
    place = F.col("mark.rank") / (1 + F.col("mark.rank"))
    ranked = _ranked(sizes, sources, cap, small).where("mark is not null").withColumns({"bin": F.floor(place * BINS), "sub": F.floor(place * (BINS * BINS))})
    first = F.first("rest").alias("rest")

    def in_cut(rows: DataFrame, cut: DataFrame, column: str) -> DataFrame:
        return _with_sources(rows.drop("rest"), cut, small).where(F.col(column) == F.col("at")).drop("at")

    cut = _first_above(ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), first, F.lit(0).alias("before")), "bin")
    some = in_cut(ranked, cut, "bin")
    cut = _first_above(some.groupBy("source", "sub").agg(F.sum("size").alias("words"), first, F.first("before").alias("before")), "sub")
    some = in_cut(some.drop("before"), cut, "sub")
    marks = some.groupBy("source", "mark").agg(F.sum("size").alias("words"), first, F.first("before").alias("before"), F.count("*").alias("n"))
    cut = _first_above(marks, "mark")
    size = F.col("cut.size")
    among = F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("before") - size / 2) / size) + 1).cast("long")
    cut = cut.join(marks.select(F.col("source").alias("_source"), F.col("mark").alias("_mark"), "n"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("at") == F.col("_mark")))
    cut = cut.select("source", F.col("at").alias("cut"), "before", "rest", "n").withColumn("among", among).select("source", "cut", F.least("among", "n").alias("among"), "n")
    return checkpointed(_with_sources(sources.drop("rest"), cut, small))


def taken(rows: DataFrame, plan: DataFrame, cap: int, tell_apart: Column) -> DataFrame:
    """rows (id, source, size, u and any others) with source_size, target and copies."""
    small = plan.count() <= BROADCAST_SOURCES
    ranked = _ranked(rows, plan, cap, small)
    at_cut = F.col("cut").isNotNull() & F.col("mark").isNotNull() & F.col("mark").eqNullSafe(F.col("cut"))
    more = F.when(F.col("mark").isNull(), 0).when(F.col("cut").isNull() | (F.col("mark") < F.col("cut")), 1).otherwise(F.when(at_cut & (F.col("among") > 0), 1).otherwise(0))
    columns = [*rows.columns, "source_size", "target"]
    if plan.where("among > 0 and among < n").isEmpty():  # no cut among rows that share its mark
        return ranked.select(*columns, (F.col("whole") + more).alias("copies"))
    parted = at_cut & (F.col("among") < F.col("n"))
    number = F.row_number().over(Window.partitionBy("source").orderBy(tell_apart))
    some = ranked.where(parted).withColumn("place", number).select(*columns, (F.col("whole") + (F.col("place") <= F.col("among")).cast("long")).alias("copies"))
    return ranked.where(~parted).select(*columns, (F.col("whole") + more).alias("copies")).unionByName(some)


def copies(sizes: DataFrame, weights: list[int] = (3, 1, 2), epochs: float = 1.5, cap: int = 2) -> DataFrame:
    """From checkpointed rows (id, source, size, u): the rows with source_size, target and copies."""
    return taken(sizes, plan_sources(sizes, list(weights), epochs, cap), cap, F.col("id"))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), epochs: float = 1.5, cap: int = 2) -> DataFrame:
    """The rows of docs (doc_id, source, text and any others), each as often as the mix takes it."""
    plan = plan_sources(checkpointed(docs.select(*described(docs))), list(weights), epochs, cap)
    # The row as one column, so that no name in it can clash.
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), *described(docs))
    mixed = taken(rows, plan, cap, F.xxhash64("row.text"))
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_pareto_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = checkpointed(docs.select(*described(docs)))
    return copies(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s2 AS (SELECT *, source_size * 2 AS most, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s1),
s3 AS (SELECT *, most::DOUBLE / weight AS room FROM s2),
s4 AS (SELECT *, row_number() OVER (ORDER BY room, source NULLS LAST) AS place,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM s3),
s5 AS (SELECT source, source_size, least(most::DOUBLE, (SELECT arg_min(level, place) FROM s4 WHERE level < room) * weight) AS target FROM s4),
s6 AS (SELECT source, source_size, coalesce(target, 2.0::DOUBLE * source_size) AS target FROM s5),
classes AS (
  SELECT sizes.source, length(bin(size)) AS class, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target
  FROM sizes JOIN s6 ON sizes.source IS NOT DISTINCT FROM s6.source GROUP BY 1, 2),
c1 AS (
  SELECT *, CASE WHEN sum(words) OVER onward > 0 THEN (target - (2 * coalesce(sum(words) OVER earlier, 0))::DOUBLE) / (sum(class * words) OVER onward)::DOUBLE END AS level
  FROM classes
  WINDOW onward AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    earlier AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT source, arg_max(level, class) FILTER (level * class <= 2) AS level FROM c1 GROUP BY source),
c3 AS (
  SELECT classes.*, c2.level, coalesce(least(2.0::DOUBLE, c2.level * class), 2.0::DOUBLE) AS expected
  FROM classes JOIN c2 ON classes.source IS NOT DISTINCT FROM c2.source),
s7 AS (SELECT source, any_value(level) AS level, any_value(target) - sum(CAST(floor(expected) AS BIGINT) * words)::DOUBLE AS rest FROM c3 GROUP BY source),
shares AS (
  SELECT sizes.*, s6.source_size, s6.target, s7.rest, coalesce(least(2.0::DOUBLE, level * length(bin(size))), 2.0::DOUBLE) AS expected
  FROM sizes JOIN s6 ON sizes.source IS NOT DISTINCT FROM s6.source JOIN s7 ON sizes.source IS NOT DISTINCT FROM s7.source),
ranked AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p,
    CASE WHEN expected > floor(expected) THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS q FROM shares),
done AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM ranked)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN q IS NOT NULL AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM done
"""
