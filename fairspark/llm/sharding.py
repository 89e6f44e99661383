"""Jump consistent hashing as column expressions, with gapless slots inside shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairspark.llm.tables import stored

#: Published multiplier of the generator (Lamping and Veach), and the size of its state.
MULTIPLIER = 2862933555777941757
STATE = 1 << 64
#: Rows that one window of slots holds at most, about.
ROWS_PER_BLOCK = 100_000
#: Copies of one repeated row that are numbered together.
COPIES = 10_000


def key_text(column: Column) -> Column:
    """md5 of a value's text; null counts as the empty text."""
    return F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard among ``n_shards`` of a key given as 16 hex digits, without a table of shards.

    The generator runs inside ``aggregate``. Each jump lands behind the one before, so ``n_shards``
    steps always suffice. From n to n + 1 shards a key stays or moves to the new one.
    """
    if n_shards < 1:
        raise ValueError("needs at least one shard")
    wide = lambda value: F.lit(str(value)).cast("decimal(20,0)")

    def step(s: Column, _: Column) -> Column:
        state = ((s["state"] * wide(MULTIPLIER) + wide(1)) % wide(STATE)).cast("decimal(38,0)")
        top = ((state - state % wide(1 << 33)) / wide(1 << 33)).cast("bigint")
        ahead = F.floor((s["ahead"] + 1) * (F.lit(float(1 << 31)) / (top + 1))).cast("bigint")
        jumped = F.struct(state.alias("state"), s["ahead"].alias("shard"), ahead.alias("ahead"))
        return F.when(s["ahead"] >= n_shards, s).otherwise(jumped)

    first = F.struct(
        F.conv(key, 16, 10).cast("decimal(38,0)").alias("state"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("ahead")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), first, step, lambda s: s["shard"].cast("int"))


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of every document now and with one shard more, and its slot in the shard.

    The shard depends on the id and the number of shards alone. Slots number a shard's rows without
    gaps in the order of the id's md5, size and checksum: leading md5 digits cut each shard into
    blocks, one row per block gives the slots before it, and only blocks are sorted. Texts are never
    shuffled. Rows that agree in id, size and checksum are combined first and numbered together, so
    that a row repeated very often does not fill a block.

    A null id counts as the empty text, a null text has size 1 and the checksum of the empty text.
    Extra columns are ignored.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    md5 = key_text(F.col(id_col))
    key = F.substring("md5", 1, 16)
    thin = docs.select(F.col(id_col).alias("id"), md5.alias("md5"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    thin = thin.groupBy("id", "md5", "size", "crc").agg(F.count("*").alias("n"))
    thin = thin.withColumns({"shard": jump_shard(key, n_shards), "grown": jump_shard(key, n_shards + 1)})
    thin = stored(thin, "shards")

    total = thin.agg(F.sum("n").alias("n")).first()["n"] or 0
    digits = math.ceil(math.log(max(1, total / ROWS_PER_BLOCK / n_shards), 16))
    thin = thin.withColumn("block", F.substring("md5", 1, digits) if digits else F.lit(""))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = thin.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("shard", "block").orderBy("md5", "size", "crc", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = thin.withColumn("local", F.sum("n").over(inside) - F.col("n")).join(blocks, ["shard", "block"])
    placed = placed.withColumn("from", F.col("local") + F.col("earlier"))

    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    few = placed.where(F.col("n") <= COPIES).withColumn("copy", F.explode(numbers))
    many = placed.where(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}"))))
    many = many.repartition("md5", "part").withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)))
    return few.unionByName(many.drop("part")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("from") + F.col("copy")).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


#: The same for documents over 8 shards. crc32 is folded over the bytes with a table made from its polynomial.
SHARD_SQL = f"""
WITH RECURSIVE
numbers AS (SELECT range AS v FROM range(256)),
bits AS (
  SELECT v AS byte, v::BIGINT AS c, 0 AS k FROM numbers
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
thin AS (
  SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '')) AS md5, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents
),
summed AS (
  SELECT doc_id, md5, size,
    xor(list_reduce(list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc
  FROM thin, crc_table
),
jumps AS (
  SELECT md5, m AS n_shards, ('0x' || substr(md5, 1, 16))::UBIGINT::HUGEINT AS state, -1::BIGINT AS shard, 0::BIGINT AS ahead
  FROM (SELECT DISTINCT md5 FROM thin), (VALUES (8), (9)) AS s(m)
  UNION ALL
  SELECT md5, n_shards, nxt, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * {MULTIPLIER}::HUGEINT + 1) % {STATE}::HUGEINT AS nxt FROM jumps WHERE ahead < n_shards)
),
ended AS (SELECT md5, max(shard) FILTER (n_shards = 8) AS shard, max(shard) FILTER (n_shards = 9) AS grown FROM jumps GROUP BY md5)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5, size, crc, doc_id) - 1 AS slot, grown::INTEGER AS grown_shard
FROM summed JOIN ended USING (md5)
"""
