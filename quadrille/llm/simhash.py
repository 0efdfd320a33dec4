"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; fingerprints link at two or fewer differing bits. It is cut into two
segments only: of two linked fingerprints, one segment then differs by at most one bit. So each
segment is indexed under its 32 one-wildcard variants (one bit deleted), an equality join on the
variants brings every linked pair together, and the pair is verified. A pair comes up under many
variants; only the first one that fits yields it.

The index holds different fingerprints, not documents: exact copies never meet in it. A variant
that over HOT_BUCKET fingerprints share would compare them pair by pair; these fingerprints are
joined instead on their two-wildcard variants over all 64 bits, of which at most four share one,
each of them linked to the others. So the work stays in proportion to the number of fingerprints
and no link is lost.

Components are found by alternating large-star and small-star rounds on the links, each round
checkpointed in the shared folder; nothing but counts comes to the driver. The least neighbour of each
node is written before it is joined back, so both sides of that join are dealt out for it and adaptive
execution can split the node of a giant component.

Defined results: a null or blank text has fingerprint zero and is linked like any other; texts of
fewer than three words have one shingle; repeated rows get the same values; a component's id is its
smallest doc_id, null ids aside (null only if all are null); an empty table gives an empty table; other
columns are ignored or, by `keep_one`, kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed, map_rows, quoted, table

SHINGLE, SEED = 3, 42
BLOCK = 1 << 16
#: Fingerprints under one variant up to which they are compared pair by pair.
HOT_BUCKET = 1024


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and words between 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of each row."""
    kind = dict(docs.dtypes)["doc_id"]
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return map_rows(docs, [F.col("text"), F.col("doc_id"), text_hash], f"doc_id {kind}, fp long, text_hash long", lambda: lambda text, key, h: (key, signed(fingerprint(text)), h))


#: Variant i of fp: segment i / 32 without its bit i % 32, with i above it.
_VARIANT = "shiftleft(cast(i as bigint), 32) | (shiftrightunsigned(fp, if(i < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, i % 32))"

#: The first variant under which a and b meet: that of the lowest segment with one differing bit at most.
_FIRST = """
CASE WHEN bit_count((a ^ b) & 4294967295L) = 0 THEN 0
     WHEN bit_count((a ^ b) & 4294967295L) = 1 THEN bit_count(((a ^ b) & 4294967295L) - 1)
     WHEN bit_count(shiftrightunsigned(a ^ b, 32)) = 0 THEN 32
     ELSE 32 + bit_count((shiftrightunsigned(a ^ b, 32) & -shiftrightunsigned(a ^ b, 32)) - 1) END
"""


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b), a < b, of different fingerprints (column fp, without repeats): all of them, or a star in place of a clique of up to four."""
    # Each fingerprint becomes 64 rows, so few partitions would make long tasks.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", F.expr(_VARIANT).alias("key"))
    shared = checkpointed(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    first = F.expr(_FIRST) == F.shiftright("key", 32)
    close = F.expr("bit_count(a ^ b) <= 2")
    twos = shared.where("n = 2").where(close & first).select("a", "b")

    # Shuffled at every size: the join of few with itself then needs no shuffle of its own.
    few = variants.join(shared.where((F.col("n") > 2) & (F.col("n") <= hot_bucket)).select("key").hint("merge"), "key", "left_semi")
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b").withColumnRenamed("key", "key2")
    pairs = left.join(right, (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & close & first).select("a", "b")

    hot_keys = shared.where(F.col("n") > hot_bucket).select("key")
    # Asked first: else all variants are shuffled for the join below before Spark sees that there is nothing to join, or not, as the stages happen to end.
    if hot_keys.isEmpty():
        return twos.unionByName(pairs)
    hot = variants.join(hot_keys, "key", "left_semi").select("fp").distinct()
    wild = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.expr("sequence(i + 1, 63)")).alias("j"))
    masked = wild.withColumn("rest", F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))"))
    # At most four share one variant, so the set that is gathered is bounded.
    star = masked.groupBy("i", "j", "rest").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    stars = star.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b").distinct()
    return twos.unionByName(pairs).unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        count = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(count) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(count)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = checkpointed(small.distinct())


def component_table(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(fp, component_id) for each fingerprint, from a checkpointed table of doc_id and fp."""
    fps = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    stars = components(links(fps.select("fp"), hot_bucket)).withColumnRenamed("node", "fp")
    linked = checkpointed(fps.join(stars, "fp"))
    ids = checkpointed(linked.groupBy("root").agg(F.min("rep").alias("component_id")))
    found = linked.join(ids, "root").select("fp", "component_id")
    rest = fps.join(found.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    return checkpointed(rest.unionByName(found))


def with_components(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """The rows of prints (checkpointed) with component_id."""
    return prints.join(component_table(prints, hot_bucket), "fp", "left")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, of which one stays of each component: that with the smallest doc_id, then text hash."""
    prints = checkpointed(fingerprints(docs))
    known = with_components(prints)
    # A component without ids is named by its smallest fingerprint's table row: by fp itself.
    name = F.struct(F.col("component_id").isNull().alias("none"), F.coalesce(F.col("component_id").cast("string"), F.col("fp").cast("string")).alias("name"))
    keys = known.groupBy(name.alias("component"), "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = checkpointed(keys)
    # Written, so that both sides of the join are dealt out for it and a large component can be split.
    best = checkpointed(keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")).alias("best")))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    judged = keys.join(best, "component").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n", stays.alias("stays"))
    # Only what goes, or is there more than once, is joined to the documents: their rows as one column, so that no name in it can clash.
    odd = checkpointed(judged.where("not stays or n > 1").drop("n"))
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col("doc_id"), text_hash.alias("text_hash"))
    joined = rows.join(odd, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    single = joined.where("stays is null").select("row.*")
    if odd.where("stays").isEmpty():
        return single
    return single.unionByName(joined.where("stays").dropDuplicates(["doc_id", "text_hash"]).select("row.*"))


def op6_simhash_dedup(spark, sf_dir):
    prints = checkpointed(fingerprints(table(spark, sf_dir, "documents")))
    return with_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
