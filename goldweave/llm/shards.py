"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits, the cells are ordered along the
Hilbert curve, and the order is cut into runs.  Neighbouring rows then agree in
most dimensions, so the min/max statistics of a shard's files prune scans that
filter on any of them.  Law ``rows``: the counts of two shards differ by one at
most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import materialise, table


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells, shape (rows, dimensions), as unsigned 64-bit.

    Uses the transpose form: undo the excess work of the Gray code from the
    highest bit down, Gray-encode, then interleave the bits.  Needs
    dimensions * bits <= 63.
    """
    x = np.asarray(cells, dtype=np.uint64).T.copy()
    dims, n = x.shape
    if dims * bits > 63:
        raise ValueError(f"{dims} dimensions of {bits} bits need more than 63 bits")
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for d in range(dims):
            is_set = (x[d] >> np.uint64(level)) & one == one
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(is_set, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(n, dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        top = (x[dims - 1] >> np.uint64(level)) & one == one
        flip ^= np.where(top, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    index = np.zeros(n, dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << one) | ((x[d] >> np.uint64(level)) & one)
    return index


def with_hilbert(df: DataFrame, cells: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with ``out``, the ``hilbert_index`` of the bigint columns ``cells``, which are used up.

    The same steps as ``hilbert_index``, one projection each, inside generated
    code; a null cell counts as 0.
    """
    dims = len(cells)
    if dims * bits > 63:
        raise ValueError(f"{dims} dimensions of {bits} bits need more than 63 bits")
    x = [F.col(c) for c in cells]
    long = lambda v: F.lit(v).cast("long")
    df = df.withColumns({c: F.coalesce(F.col(c), long(0)).cast("long") for c in cells})
    is_set = lambda c, level: F.shiftright(c, level).bitwiseAND(long(1)) == 1
    for level in range(bits - 1, 0, -1):
        low = long((1 << level) - 1)
        df = df.withColumn(cells[0], F.when(is_set(x[0], level), x[0].bitwiseXOR(low)).otherwise(x[0]))
        for d in range(1, dims):
            swap = x[0].bitwiseXOR(x[d]).bitwiseAND(low)
            turned = is_set(x[d], level)
            df = df.withColumns({cells[0]: x[0].bitwiseXOR(F.when(turned, low).otherwise(swap)), cells[d]: F.when(turned, x[d]).otherwise(x[d].bitwiseXOR(swap))})
    for d in range(1, dims):
        df = df.withColumn(cells[d], x[d].bitwiseXOR(x[d - 1]))
    flip = long(0)
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(is_set(x[-1], level), long((1 << level) - 1)).otherwise(long(0)))
    df = df.withColumn(out, flip)
    index = long(0)
    for level in range(bits):
        for d in range(dims):
            bit = F.shiftright(x[d].bitwiseXOR(F.col(out)), level).bitwiseAND(long(1))
            index = index.bitwiseOR(F.shiftleft(bit, level * dims + dims - 1 - d))
    return df.withColumn(out, index).drop(*cells)


def category_cell(column: Column, bits: int) -> Column:
    """Cell of a category: the top bits of its CRC; null has cell 0."""
    return F.coalesce(F.shiftright(F.crc32(column.cast("string").cast("binary")), 32 - bits), F.lit(0)).cast("long")


def size_cell(column: Column, bits: int) -> Column:
    """Cell of a size: four for each doubling of size + 1, from its leading bits; null and negative sizes count as 0."""
    n = F.greatest(F.coalesce(column.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")) + 1
    doublings = F.length(F.bin(n)) - 1
    cell = doublings * 4 + F.call_function("shiftright", n * 4, doublings) - 4
    return F.least(cell, F.lit((1 << bits) - 1)).cast("long")


def ordinal(df: DataFrame, keys: list[str], name: str, rows_per_partition: int = 1_000_000) -> tuple[DataFrame, int]:
    """``df`` with ``name``: the position of each row, from 0, in the order of ``keys``; and the number of rows.

    A range exchange sorts; the ranges are written down, so that a lost
    executor can't move them; then each range's offset is added.  Only the
    number of rows per range, one number per partition, reaches the driver.
    ``df`` has no columns named ``_place``, ``_range`` or ``_offset``.
    """
    spark = df.sparkSession
    n = df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_partition + 1)
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", place)
    ranged = materialise(ranged, "ordinal")
    low = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(F.shiftright("_place", 33).alias("_range")).count().collect()
    offsets, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        offsets[r["_range"]] = total
        total += r["count"]
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_place"), 0
    by_range = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if len(offsets) <= 64 else None
    if by_range is not None:
        out = ranged.withColumn(name, (by_range[F.shiftright("_place", 33)] + low).cast("long"))
    else:  # one row per range: at most `parts` rows of 16 bytes
        small = spark.createDataFrame([(k, v) for k, v in offsets.items()], "_range long, _offset long")
        out = ranged.withColumn("_range", F.shiftright("_place", 33)).join(F.broadcast(small), "_range").withColumn(name, F.col("_offset") + low).drop("_range", "_offset")
    return out.drop("_place"), total


def hilbert_shards(df: DataFrame, cells: dict[str, Column], tie_keys: list[str], shards: int = 40, bits: int = 8) -> DataFrame:
    """``df`` with ``hilbert``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    ``cells`` holds the quantised dimensions; rows of one cell are ordered by
    ``tie_keys`` and may be cut anywhere, so a hot cell spreads over as many
    shards as its rows need.  A null cell counts as 0, a null tie key goes
    first.  Repeated rows take slots of their own; an empty table gives no
    rows.  Columns of ``df`` that are named as the three outputs are replaced;
    all others stay, whatever they are called.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(f"c{i}") for i, c in enumerate(cells.values())], *[F.col(f"`{k}`").alias(f"t{i}") for i, k in enumerate(tie_keys)])
    keyed = with_hilbert(packed, [f"c{i}" for i in range(len(cells))], bits, "h")
    keys = [f"t{i}" for i in range(len(tie_keys))]
    placed, n = ordinal(keyed, ["h", *keys], "pos")
    base, extra = divmod(n, shards)
    wide = extra * (base + 1)
    pos = F.col("pos")
    if base:
        shard = F.when(pos < wide, F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - wide) / base)).cast("int")
    else:
        shard = pos.cast("int")
    start = F.when(F.col("s") < extra, F.col("s") * (base + 1)).otherwise(wide + (F.col("s") - extra) * base)
    kept = [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in ("hilbert", "shard", "slot")]
    return placed.withColumn("s", shard).select(*kept, F.col("h").alias("hilbert"), F.col("s").alias("shard"), (pos - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as Parquet folders ``shard=n``, rows in the order of their slots: no further exchange, since neighbours already share partitions."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """One row per shard: its number of rows, and ``min_c`` and ``max_c`` of each column, as a scan prunes by them."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39 by law ``rows``, along language, source and size; equal texts of one cell are neighbours.

    A null text has size 16 and CRC 0, as an empty one has.
    """
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
        category_cell(F.col("lang"), 8).alias("c_lang"),
        category_cell(F.col("source"), 8).alias("c_source"),
    )
    cells = {"lang": F.col("c_lang"), "source": F.col("c_source"), "size": size_cell(F.col("size"), 8)}
    out = hilbert_shards(docs, cells, ["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def _crc_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes: the polynomial's table is linear, so eight bits stand for its entries."""
    entry = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        entry.append(c)
    low = "0"
    for k, c in enumerate(entry):
        low = f"xor({low}, {c} * ((xor(c, b) >> {k}) & 1))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, {low})), 4294967295)"


def _op1_sql(bits: int = 8, shards: int = 40) -> str:
    """The contract's rows in DuckDB: the curve as a chain of steps over bits, the shards from row numbers."""
    steps = ["x0, x1, x2"]

    def then(**new: str) -> None:
        steps.append(", ".join(f"{new[c]} AS {c}" if c in new else c for c in ("x0", "x1", "x2")))

    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        then(x0=f"CASE WHEN (x0 >> {level}) & 1 = 1 THEN xor(x0, {low}) ELSE x0 END")
        for c in ("x1", "x2"):
            on, swap = f"({c} >> {level}) & 1 = 1", f"(xor(x0, {c}) & {low})"
            then(**{"x0": f"CASE WHEN {on} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END", c: f"CASE WHEN {on} THEN {c} ELSE xor({c}, {swap}) END"})
    then(x1="xor(x1, x0)")
    then(x2="xor(x2, x1)")
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN (x2 >> {level}) & 1 = 1 THEN {(1 << level) - 1} ELSE 0 END)"
    then(x0=f"xor(x0, {flip})", x1=f"xor(x1, {flip})", x2=f"xor(x2, {flip})")
    chain = ", ".join(f"s{i} AS MATERIALIZED (SELECT doc_id, size, crc, {step} FROM {'d' if not i else f's{i - 1}'})" for i, step in enumerate(steps))
    index = " + ".join(f"(((x{d} >> {level}) & 1) << {level * 3 + 2 - d})" for level in range(bits) for d in range(3))
    cell = lambda c: f"coalesce({_crc_sql(c)} >> {32 - bits}, 0)"
    n = "(size + 1)"
    log = f"(length(bin({n})) - 1)"
    return f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size FROM documents),
d AS MATERIALIZED (SELECT doc_id, size, {_crc_sql("text")} AS crc, {cell("lang")} AS x0, {cell("source")} AS x1, CAST(least(4 * {log} + (({n} * 4) >> {log}) - 4, {(1 << bits) - 1}) AS BIGINT) AS x2 FROM b),
{chain},
h AS (SELECT doc_id, size, crc, CAST({index} AS BIGINT) AS hilbert FROM s{len(steps) - 1}),
p AS (SELECT *, row_number() OVER (ORDER BY hilbert, crc, size, doc_id) - 1 AS pos, count(*) OVER () // {shards} AS base, count(*) OVER () % {shards} AS extra FROM h),
q AS (SELECT *, CASE WHEN pos < extra * (base + 1) THEN pos // (base + 1) ELSE extra + (pos - extra * (base + 1)) // base END AS shard FROM p)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - shard * base - least(shard, extra) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert FROM q
"""


OP1_SQL = _op1_sql()
