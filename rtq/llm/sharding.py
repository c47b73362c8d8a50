"""Sharding (operator 8): extendible hashing to a byte limit.

A document's key hashes to 48 bits.  The directory starts as one bucket; a
bucket over the limit splits on its next bit, and only such buckets split.  The
splits are decided on byte counts per hash prefix, gathered by map-side sums at
the directory's depth, never on rows; where a cell at that depth is still too
large, the next round counts just the rows of such cells at more bits.

No bit can part rows of one key.  A cell still too large at the last bit is cut
by running bytes over salted parts instead, so every shard fits.  A row that is
larger than the limit by itself gets a shard of its own, repeated ones too.

Defined cases: a null text has 0 bytes; a null key hashes like the empty
string; repeated rows share a bucket, or the running cut; an empty table gives
no shards; columns of the input are kept, and the columns added here replace
input columns of the same name; other names may clash with internal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rtq.llm.names import guarded
from rtq.llm.queries import register, table
from rtq.session import cut_lineage

HASH_BITS = 48
#: Production limit of a shard file, and the limit of the registered query.
SHARD_BYTES = 256 << 20
QUERY_SHARD_BYTES = 1 << 20
#: The directory is broadcast up to so many cells (16 bytes each).
BROADCAST_CELLS = 200_000
#: Salted parts of a cell whose rows share one key.
PARTS = 64

ADDED = ["shard_id", "shard_depth", "row_bytes"]


def key_hash(key: Column) -> Column:
    """The first 48 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_CELLS else df


def _settle(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Decide cells counted at ``high`` bits: adds ``depth`` of the bucket each
    falls into (the least depth above ``low`` whose bytes fit; null: none fits)."""
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    return cells.select("cell").join(
        levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth")), "cell", "left")


@guarded()
def assign_shards(rows: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``shard_id``, ``shard_depth`` and ``row_bytes``."""
    keep = [c for c in rows.columns if c not in ADDED]
    rows = rows.select(*keep).withColumns({"row_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
                                           "_h": key_hash(F.col(key))})
    big = F.col("row_bytes") > limit
    total, n_big = rows.agg(F.coalesce(F.sum("row_bytes"), F.lit(0)), F.count_if(big)).first()
    step = max(1, min(20, (total // limit).bit_length() + 2))
    alone = _single_rows(rows.where(big), text) if n_big else None
    rows = rows.where(~big) if n_big else rows
    sized = rows.select("_h", "row_bytes")
    low, open_cells, found = 0, None, []
    while True:
        high = min(HASH_BITS, low + step)
        here = sized
        if open_cells is not None:
            here = sized.withColumn("_up", F.shiftright("_h", HASH_BITS - low)).join(
                open_cells.select(F.col("cell").alias("_up")), "_up", "left_semi")
        cells = here.groupBy(F.shiftright("_h", HASH_BITS - high).alias("cell")).agg(F.sum("row_bytes").alias("bytes"))
        cells = cut_lineage(cells, "cells")
        directory = cut_lineage(_settle(cells, low, high, limit), "directory")
        n, left = directory.agg(F.count(F.lit(1)), F.count_if(F.col("depth").isNull())).first()
        found.append((high, directory, n))
        open_cells = directory.where("depth IS NULL")
        low = high
        if not left or high == HASH_BITS:
            break
    out = rows.withColumn("shard_depth", F.lit(None).cast("int"))
    for high, directory, n in found:
        cell = f"_c{high}"
        d = _small(directory.select(F.col("cell").alias(cell), F.col("depth").alias("_d")).where("depth IS NOT NULL"), n)
        out = out.withColumn(cell, F.when(F.col("shard_depth").isNull(), F.shiftright("_h", HASH_BITS - high)))
        out = out.join(d, cell, "left").withColumn("shard_depth", F.coalesce("shard_depth", F.col("_d").cast("int"))).drop("_d", cell)
    named = F.when(F.col("shard_depth").isNotNull(), F.concat_ws(
        "-", F.col("shard_depth").cast("string"), F.expr(f"shiftright(_h, {HASH_BITS} - shard_depth)").cast("string")))
    out = out.withColumn("shard_id", named)
    if left:
        out = out.where("shard_id IS NOT NULL").unionByName(_cut_cells(out.where("shard_id IS NULL"), limit))
    out = out.select(*keep, *ADDED)
    return out.unionByName(alone.select(*keep, *ADDED)) if n_big else out


def _single_rows(rows: DataFrame, text: str) -> DataFrame:
    """Rows over the limit, each a shard of its own: written once with a number, by
    which repeated rows differ."""
    name = F.concat(F.lit("big-"), F.hex("_h"), F.lit("-"), F.md5(F.coalesce(F.col(text), F.lit(""))), F.lit("-"),
                    F.monotonically_increasing_id().cast("string"))
    return cut_lineage(rows.withColumns({"shard_depth": F.lit(None).cast("int"), "shard_id": name}), "big-rows")


def _cut_cells(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one key: running bytes over salted parts.  A part is cut where its
    running bytes pass a multiple of the limit less its largest row, so a piece
    never holds more than the limit."""
    rows = cut_lineage(rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "cells-of-a-key")
    part = Window.partitionBy("_h", "_part")
    run = F.sum("row_bytes").over(part.orderBy("row_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"_at": run - F.col("row_bytes"), "_most": F.max("row_bytes").over(part)})
    piece = F.floor(F.col("_at") / F.greatest(F.lit(1), F.lit(limit) - F.col("_most")))
    return rows.withColumn("shard_depth", F.lit(HASH_BITS)).withColumn("shard_id", F.concat_ws(
        "-", F.lit(str(HASH_BITS)), F.col("_h").cast("string"), F.col("_part").cast("string"), piece.cast("string"))
    ).drop("_part", "_at", "_most")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard meet in one task, which its limit bounds."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS row_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
     f AS (SELECT * FROM d WHERE row_bytes <= {QUERY_SHARD_BYTES}),
     p AS (SELECT depth, h >> ({HASH_BITS} - depth)::INT AS prefix, sum(row_bytes) AS total FROM f, range(0, 32) AS g(depth) GROUP BY ALL),
     a AS (SELECT f.doc_id, f.row_bytes, min(p.depth) AS depth, min_by(p.prefix, p.depth) AS prefix,
                  min_by(p.total, p.depth) AS total FROM f JOIN p ON p.prefix = f.h >> ({HASH_BITS} - p.depth)::INT AND p.total <= {QUERY_SHARD_BYTES}
           GROUP BY f.doc_id, f.row_bytes)
SELECT doc_id, row_bytes, depth::INTEGER AS shard_depth, depth || '-' || prefix AS shard_id, total::BIGINT AS shard_bytes FROM a
"""


@register("op8_sharding", ORACLE)
def op8_sharding(spark, sf_dir):
    out = assign_shards(table(spark, sf_dir, "documents"), QUERY_SHARD_BYTES).select("doc_id", "row_bytes", "shard_depth", "shard_id")
    sizes = out.groupBy("shard_id").agg(F.sum("row_bytes").alias("shard_bytes"))
    return out.join(sizes, "shard_id").select("doc_id", "row_bytes", "shard_depth", "shard_id", "shard_bytes")
