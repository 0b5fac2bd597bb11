"""Exact duplicates by a log-structured merge index of digests.

Every input task is a memtable: it flushes one Parquet run of (digest, doc_id), sorted by digest.
Compaction merges the runs into one level that holds, for each digest, the entry that stays and the
number of entries; ``merge`` takes the runs of a later batch into a level. A filter, one bit for the
hash of each digest, says which digests a level may hold: probing it before texts are moved leaves the
documents that can't be hits where they are. A document whose digest has several entries is a hit;
hits are verified byte by byte against the text of the entry that stays, so a digest collision can't
join different texts.

Defined results
    null text: the empty text. null doc_id: below every other id. Repeated rows: counted one by one,
    exactly one row of a group stays. Empty table: empty result. Other columns are never read; a
    column that clashes with an output name does no harm since only the two inputs are selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: Rows of one digest that meet one copy of the text that stays.
ROWS_PER_COPY = 4096
#: Bits of a filter for each of its digests, and its bits at most, so that it may be sent to all tasks (32 MB).
BITS_PER_DIGEST, MOST_BITS = 16, 1 << 28


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One sorted run per input task: (digest, doc_id, row)."""
    rows = docs.select(
        digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
    )
    return staged(rows.sortWithinPartitions("digest"), "runs")


def compact(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """Merge runs to one level: (digest, keep_id, keep_row, n).

    ``keep`` says whether the largest or the smallest doc_id of a digest stays.
    """
    pick = F.max if keep == "largest" else F.min
    # on equal ids the later (or earlier) row wins, so one row of each group stays
    level = runs.groupBy("digest").agg(pick(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n"))
    level = level.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "n")
    return staged(level, "level")


def merge(level: DataFrame, runs: DataFrame, keep: str = "largest") -> DataFrame:
    """The level after the runs of a later batch; on equal ids the entry of the level stays."""
    old = level.select("digest", F.struct(F.col("keep_id").alias("doc_id"), F.lit(1).alias("old"), F.col("keep_row").alias("row")).alias("top"), "n")
    new = runs.select("digest", F.struct("doc_id", F.lit(0).alias("old"), "row").alias("top"), F.lit(1).cast("bigint").alias("n"))
    if keep == "smallest":
        flip = lambda df: df.withColumn("top", F.struct("top.doc_id", (1 - F.col("top.old")).alias("old"), "top.row"))
        old, new = flip(old), flip(new)
    pick = F.max if keep == "largest" else F.min
    both = old.unionByName(new).groupBy("digest").agg(pick("top").alias("top"), F.sum("n").alias("n"))
    return staged(both.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "n"), "level")


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits)) + 1


def filter_of(digests: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of a filter over a column digest, and its number of bits: a power of two that doesn't pass ``MOST_BITS``."""
    n = digests.count()
    bits = 1 << 15
    while bits < min(BITS_PER_DIGEST * n, MOST_BITS):
        bits *= 2
    at = _bit(F.col("digest"), bits)
    rows = digests.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return staged(rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "filter"), bits


def probed(rows: DataFrame, digest: str, maps: DataFrame, bits: int) -> DataFrame:
    """The rows whose digest may be in the filter; all that are in it, and a few others."""
    bucket, bit, held = fresh(rows, "_bucket"), fresh(rows, "_bit"), fresh(rows, "_bitmap")
    at = _bit(F.col(digest), bits)
    named = maps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(held))
    placed = rows.withColumns({bucket: F.bitmap_bucket_number(at), bit: F.bitmap_bit_position(at)})
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = placed.join(F.broadcast(named), bucket)  # MOST_BITS at most
    return joined.where(F.call_function("getbit", byte, (F.col(bit) % 8).cast("int")) == 1).select(*rows.columns)


def collisions(docs: DataFrame, level: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Digests of hits whose bytes differ from the text of the entry that stays."""
    hits = level.where("n > 1").select(F.col("digest").alias("d"), "keep_id", F.ceil(F.col("n") / ROWS_PER_COPY).alias("copies"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("d", digest(F.col("text")))
    maps, bits = filter_of(hits.select(F.col("d").alias("digest")))
    rows = probed(rows, "d", maps, bits).join(hits, "d")
    # by row, as ids may repeat
    salt = F.pmod(F.xxhash64("row"), F.col("copies"))
    rows = staged(rows.select("d", "keep_id", "copies", "doc_id", salt.alias("salt"), "text"), "hits")
    # a hot digest meets its reference text in many tasks: the text is copied once per ROWS_PER_COPY rows
    kept = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("d", "copies").agg(F.first("text").alias("kept_text"))
    kept = kept.select("d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("salt"), "kept_text")
    return rows.join(kept, ["d", "salt"]).where("text <> kept_text").select(F.col("d").alias("digest")).distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, digest."""
    runs = flush(docs, id_col, text_col, digest)
    level = compact(runs, keep)
    bad = staged(collisions(docs, level, id_col, text_col, digest), "collisions")
    out = runs.join(level, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    if bad.isEmpty():
        return out
    # a digest that stands for several texts: its rows are grouped by the text itself
    pick = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text"))).join(bad, "digest")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "collided")
    groups = rows.groupBy("digest", "text").agg(pick(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n"))
    rest = rows.join(groups, ["digest", "text"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept"), "digest"
    )
    return out.join(bad, "digest", "left_anti").select(rest.columns).unionByName(rest)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns kept; of repeated rows one stays."""
    d, i = fresh(docs, "_digest"), fresh(docs, "_id")
    kept = exact_duplicates(docs, id_col, text_col, keep).where("kept").select(F.col("digest").alias(d), F.col("doc_id").alias(i))
    rows = docs.withColumn(d, sha256(F.coalesce(F.col(text_col), F.lit("")))).withColumn(i, F.col(id_col))
    same = (rows[d] == kept[d]) & rows[i].eqNullSafe(kept[i])
    return rows.join(kept, same, "left_semi").dropDuplicates([d, i]).drop(d, i)
