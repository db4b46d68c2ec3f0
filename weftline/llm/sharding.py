"""Sharding by longest-processing-time scheduling: groups of equal texts, by size, to the least-loaded shard.

The heap runs on the driver over units, of which there are at most twice N_UNITS whatever the corpus: a group
larger than 1 / N_UNITS of all bytes is a unit of its own, and the smaller ones are bundled by a hash of their
digest. Units are far smaller than a shard, so the shards' sizes end nearly equal, unless one group alone is
larger than a shard's share.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, numbered_chunks, stored, with_slots

N_UNITS = 1 << 15


def schedule(units: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """Longest processing time first: (size, name) units to shards; ties go by name, then the lower shard."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shards(docs: DataFrame, n_shards: int = 8, n_units: int = N_UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1; a null text has none, as an empty one, and both are equal texts. Equal
    texts share a shard. Slots are gapless from 0 in each shard. Repeated rows and null ids take a slot each; an
    empty table gives no rows. Texts are read once and reduced to a digest before anything is shuffled.
    """
    spark = docs.sparkSession
    narrow = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"),
    )
    narrow = stored(numbered_chunks(narrow, "chunk"), "sizes")
    bundle = F.pmod(F.xxhash64("digest"), F.lit(n_units)).cast("int")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    groups = narrow.groupBy("digest").agg(F.sum("size").alias("bytes"))
    alone = F.col("bytes") > F.lit(total // n_units)
    unit = groups.withColumn("bundle", bundle).groupBy(
        F.when(alone, F.col("digest")).alias("digest"), F.when(~alone, F.col("bundle")).alias("bundle")
    ).agg(F.sum("bytes").alias("bytes"))
    units = [(r["bytes"], (1, bytes(r["digest"])) if r["digest"] is not None else (0, r["bundle"])) for r in unit.collect()]  # < 2 n_units rows
    at = schedule(units, n_shards)
    # both tables have at most n_units rows
    large = spark.createDataFrame([(k[1], s) for k, s in at.items() if k[0] == 1], "digest binary, large_shard int")
    small = spark.createDataFrame([(k[1], s) for k, s in at.items() if k[0] == 0], "bundle int, small_shard int")
    placed = (
        narrow.withColumn("bundle", bundle)
        .join(F.broadcast(large), "digest", "left")
        .join(F.broadcast(small), "bundle", "left")
        .withColumn("shard", F.coalesce("large_shard", "small_shard"))
        .select("doc_id", "size", "text_crc32", "chunk", "shard")
    )
    slots = with_slots(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot", "chunk")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
