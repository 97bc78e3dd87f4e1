"""Operator 9: uniform shuffle into shards of exact sizes, by DataFrame functions alone.

The number of rows that each source partition sends to each shard is drawn first, from the law that a
uniform shuffle of all rows would give: a multivariate hypergeometric matrix with the partition sizes as
row sums and the shard sizes as column sums. The matrix is drawn by halving the list of partitions again
and again, so each level is a narrow step and none of it goes through the driver. Then the rows of each
partition are permuted locally, exchanged, and permuted again inside their shard.

The second permutation cuts a shard into buckets by a random key that is unique to each row, so no bucket
is hot whatever the rows hold, and the slot is the bucket's first slot plus the rank in the bucket.

Law ``rows``: shard sizes differ by one at most. Defined cases: null texts have no bytes; null or repeated
doc_ids, repeated rows and ties of any kind are rows like others; an empty table gives no rows; input columns
named shard or slot are replaced, all others pass through under any name.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_name, written

#: Bytes of text and binary columns, and rows, that a bucket of the second permutation holds on average at most.
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 20_000

#: Nodes of the matrix's tree from which on they are dealt to tasks of their own.
SPREAD_LEVEL = 8

#: The matrix (shards + 2 numbers a source partition) is broadcast up to this size and joined by shuffle beyond it.
BROADCAST_BYTES = 32 << 20

LAW = "rows"


def log_gamma(x: str) -> str:
    """SQL for the logarithm of the gamma function of a positive number: Stirling's series after a shift by 8."""
    return (
        f"(({x} + 7.5D) * ln({x} + 8) - ({x} + 8) + 0.9189385332046727D + 1 / (12 * ({x} + 8)) - 1 / (360 * pow({x} + 8, 3)) + 1 / (1260 * pow({x} + 8, 5))"
        f" - ln({x} * ({x} + 1) * ({x} + 2) * ({x} + 3)) - ln(({x} + 4) * ({x} + 5) * ({x} + 6) * ({x} + 7)))"
    )


def log_choose(n: str, k: str) -> str:
    return f"({log_gamma(f'({n} + 1)')} - {log_gamma(f'({k} + 1)')} - {log_gamma(f'({n} - {k} + 1)')})"


def bind(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(good: str, total: str, drawn: str, u: str) -> str:
    """SQL for how many of ``drawn`` items taken from ``total`` are among the ``good`` ones, by inversion at ``u``.

    Outcomes more than 9 standard deviations from the mean, whose probability is below 1e-18, are left out.
    """
    given = f"named_struct('g', double({good}), 't', double({total}), 'd', double({drawn}), 'u', double({u}))"
    mean = "if(a.t > 0, a.d * a.g / greatest(a.t, 1), 0D)"
    wide = f"sqrt(greatest(0D, {mean} * (1 - a.g / greatest(a.t, 1)) * (a.t - a.d) / greatest(a.t - 1, 1)))"
    low = "greatest(0D, a.d + a.g - a.t, double(floor(m.mean - 9 * m.wide - 2)))"
    high = "least(a.d, a.g, double(ceil(m.mean + 9 * m.wide + 2)))"
    start = f"exp({log_choose('a.g', 'e.low')} + {log_choose('(a.t - a.g)', '(a.d - e.low)')} - {log_choose('a.t', 'a.d')})"
    # once u is reached the state stays: nothing is left to pass
    step = (
        "(s, i) -> named_struct('left', if(s.left > s.p, s.left - s.p, -1D),"
        " 'p', s.p * (a.g - e.low - i) * (a.d - e.low - i) / ((e.low + i + 1) * (a.t - a.g - a.d + e.low + i + 1)),"
        " 'k', if(s.left > s.p, s.k + 1, s.k))"
    )
    walk = f"aggregate(sequence(0L, bigint(e.high - e.low - 1)), named_struct('left', a.u, 'p', {start}, 'k', e.low), {step}, s -> s.k)"
    ends = bind("e", f"named_struct('low', {low}, 'high', {high})", f"if(e.high <= e.low, e.low, {walk})")
    return f"bigint({bind('a', given, bind('m', f"named_struct('mean', {mean}, 'wide', {wide})", ends))})"


def split_counts(left_rows: str, counts: str, seed: str) -> Column:
    """How many of the ``counts`` of each shard go to the left part, which has ``left_rows`` rows in all."""
    total = f"aggregate({counts}, 0L, (x, c) -> x + c)"
    items = f"transform({counts}, (c, i) -> named_struct('n', c, 'i', i))"
    # 53 random bits, in the open interval
    u = f"(double(shiftrightunsigned(xxhash64({seed}, item.i), 11)) + 0.5D) / {float(1 << 53)!r}D"
    after = "named_struct('out', concat(state.out, array(k)), 'rows', state.rows - k, 'total', state.total - item.n)"
    step = bind("k", hypergeometric("item.n", "state.total", "state.rows", u), after)
    first = f"named_struct('out', cast(array() as array<bigint>), 'rows', bigint({left_rows}), 'total', {total})"
    return F.expr(f"aggregate({items}, {first}, (state, item) -> {step}, state -> state.out)")


def communication_matrix(sizes: DataFrame, shards: int, seed: int, levels: int) -> DataFrame:
    """part, counts (rows for each shard) from ``sizes`` (part, n); 2 ** ``levels`` is at least the number of parts.

    The list of sizes (one number a partition) stands in one row at the root and is halved with it.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "n")))
    root = sizes.agg(parts.alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))
    even = f"transform(sequence(0, {shards - 1}), s -> bigint(rows div {shards}) + bigint(s < rows % {shards}))"
    nodes = root.selectExpr("parts", f"{even} as counts", "1L as node")
    for level in range(levels):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition("node")
        nodes = nodes.selectExpr("*", "slice(parts, 1, int(ceil(size(parts) / 2))) as lp", "slice(parts, int(ceil(size(parts) / 2)) + 1, size(parts)) as rp")
        nodes = nodes.withColumn("lc", split_counts("aggregate(lp, 0L, (x, p) -> x + p.n)", "counts", f"node * 1000003 + {seed}"))
        nodes = nodes.selectExpr(
            "inline(array(named_struct('parts', lp, 'counts', lc, 'node', node * 2),"
            " named_struct('parts', rp, 'counts', zip_with(counts, lc, (c, k) -> c - k), 'node', node * 2 + 1)))"
        ).filter("size(parts) > 0")
    return nodes.selectExpr("parts[0].part as part", "counts")


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of ``docs`` with their columns, and shard (int) and slot (long, gapless from 0 in a shard)."""
    docs = docs.drop("shard", "slot")
    part, rank, key, ends, bucket, first, place = (new_name(docs, x) for x in ("part", "rank", "key", "ends", "bucket", "first", "place"))
    # the local permutation: rows sorted by a hash of their place
    placed = docs.withColumn(part, F.spark_partition_id()).withColumn(rank, F.monotonically_increasing_id())
    mixed = placed.sortWithinPartitions(F.xxhash64(F.lit(seed), rank), rank)
    table = written(mixed.withColumn(rank, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shuffle")

    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in docs.schema if f.dataType.typeName() in ("string", "binary")]
    measured = table.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(functools.reduce(operator.add, wide, F.lit(0))).alias("bytes"))
    parts, total, size = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    sizes = table.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(sizes, shards, seed, max(1, parts - 1).bit_length())
    upto = f"transform(sequence(1, {shards}), s -> aggregate(slice(counts, 1, s), 0L, (x, c) -> x + c)) as {ends}"
    bounds = matrix.selectExpr(f"part as {part}", upto)
    if parts * (shards + 2) * 8 <= BROADCAST_BYTES:
        bounds = F.broadcast(bounds)

    buckets = max(1, -(-total // (shards * bucket_rows)), -(-size // (shards * BUCKET_BYTES)))
    sent = (
        table.join(bounds, part)
        .withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(rank))))
        .drop(ends)
        .withColumn(key, F.xxhash64(F.lit(seed + 1), part, rank))
        .withColumn(bucket, F.pmod(F.shiftrightunsigned(key, 7), F.lit(buckets)).cast("int"))
    )
    # one row a bucket: the rows of the shard before it
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = sent.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(first))
    firsts = counts.withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    # the second permutation: the order of the random keys in a bucket; as many tasks as buckets
    order = Window.partitionBy("shard", bucket).orderBy(key, part, rank)
    ranked = sent.repartition(shards * buckets, "shard", bucket).withColumn(place, F.row_number().over(order)).join(firsts, ["shard", bucket])
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("shard").cast("int").alias("shard"), (F.col(first) + F.col(place) - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs`` (columns doc_id, text)."""
    rows = shuffle_to_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shards, seed)
    data = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
