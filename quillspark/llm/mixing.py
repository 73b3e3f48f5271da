"""Mixing sources to target weights by a Pfair schedule.

Each source is a stream of blocks of BLOCK rows, its rows in an order by hash, over and over (epochs). A target weight is a whole
number of shares of QUANTA. Block i of a source with p shares is released at slot floor(i Q / p) and due by slot ceil((i + 1) Q / p); of the
released blocks the earliest deadline goes first, ties by the source's name. On one sequence this meets every deadline, so at
every slot each source is less than one block from its weight. The schedule repeats after Q slots, and only these are computed, on
the driver: a block's slot follows by arithmetic, on the executors.

The mix ends when every row of every source has been placed at least once; sources that are over-weighted for their size come again in further
epochs. No row is dropped. Sources are split into buckets of about BUCKET rows for numbering, so no task gets a whole source.

A null source is a source of its own. An empty table gives an empty mix. Repeated rows keep a place each. Given weights must be
positive and name every source (None for null). Columns called like an output are replaced. With over QUANTA sources a period has four slots a source, rounded up
to a power of two; the driver computes a period, in proportion to the sources, whatever the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, q

BLOCK, QUANTA, BUCKET, ALPHA = 16, 4096, 5_000, 0.7
#: The table of sources (QUANTA slots in all) is broadcast up to so many sources; of more it is joined by a shuffle.
MAX_SOURCES = QUANTA
#: Epochs of a row that one task makes at most: a source that recurs more often is dealt to several tasks.
EPOCHS = 64


def shares_of(weights: Mapping, quanta: int = QUANTA) -> dict:
    """Weights as whole shares of quanta, by largest remainder, one at least."""
    if len(weights) > quanta:
        raise ValueError(f"more than {quanta} sources")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total, free = sum(weights.values()), quanta - len(weights)
    exact = {k: max(0.0, w / total * quanta - 1) for k, w in weights.items()}
    scale = free / sum(exact.values()) if sum(exact.values()) else 0
    out = {k: 1 + int(x * scale) for k, x in exact.items()}
    rest = sorted(exact, key=lambda k: (-(exact[k] * scale - int(exact[k] * scale)), k is not None, k or ""))
    for i in range(quanta - sum(out.values())):
        out[rest[i % len(rest)]] += 1
    return out


def schedule(shares: Mapping) -> dict:
    """The slots of each source's blocks in one period of sum(shares) slots, by earliest deadline first among the released."""
    period = sum(shares.values())
    names = sorted(shares, key=lambda k: (k is not None, k or ""))
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: dict = {k: [] for k in names}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * period // shares[names[i]]), i, block))
        _, i, block = heapq.heappop(ready)
        out[names[i]].append(slot)
        if block + 1 < shares[names[i]]:
            heapq.heappush(waiting, ((block + 1) * period // shares[names[i]], i, block + 1))
    return out


def mix(df: DataFrame, *args, **how) -> DataFrame:
    """The mix of mix_and_length() alone."""
    return mix_and_length(df, *args, **how)[0]


def mix_and_length(df: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping | None = None, block: int = BLOCK, alpha: float = ALPHA, quanta: int = QUANTA, bucket: int = BUCKET, position: str = "position", epoch: str = "epoch") -> tuple[DataFrame, int]:
    """df's rows in the mix: its columns, and the row's place in it (from 0, without gaps) and epoch; unsorted. Also the mix's number of rows.

    weights: by source; by default each source's number of rows to the power alpha.
    """
    spark = prepare(df.sparkSession)
    counts = {r[0]: r[1] for r in df.groupBy(q(source).cast("string")).count().collect()}
    if len(counts) > quanta:
        quanta = 1 << (4 * len(counts) - 1).bit_length()
    own = {k: n**alpha for k, n in counts.items()} if weights is None else {k: weights[k] for k in counts} if counts.keys() <= weights.keys() else None
    if own is None:
        raise ValueError(f"no weight for {sorted(map(str, counts.keys() - weights.keys()))[:5]}")
    shares = shares_of(own, quanta) if own else {}
    slots = schedule(shares) if shares else {}
    blocks = {k: -(-n // block) for k, n in counts.items()}
    length = max([0, *((b - 1) // shares[k] * quanta + slots[k][(b - 1) % shares[k]] + 1 for k, b in blocks.items())])
    room = {k: block * (length // quanta * shares[k] + sum(s < length % quanta for s in slots[k])) for k in shares}
    kind = T.StructType([T.StructField(n, t) for n, t in (("_s", T.StringType()), ("_n", T.LongType()), ("_b", T.LongType()), ("_p", T.LongType()), ("_room", T.LongType()), ("_turns", T.LongType()), ("_slots", T.ArrayType(T.IntegerType())))])
    plan = spark.createDataFrame([(k, n, -(-n // bucket), shares[k], room[k], -(-room[k] // (n * EPOCHS)), slots[k]) for k, n in counts.items()], kind)
    near = F.broadcast if len(counts) <= MAX_SOURCES else lambda x: x

    names = df.columns
    hashed = [q(c) for c, f in zip(names, df.schema.fields, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = df.select(F.struct(*(q(c) for c in names)).alias("_row"), q(source).cast("string").alias("_source"), F.xxhash64(q(key), F.lit("mix")).alias("_h"), F.xxhash64(*hashed).alias("_tie"))
    rows = rows.join(near(plan.select("_s", "_b", "_turns")), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_bucket", F.pmod("_h", "_b")).drop("_s", "_b")
    sizes = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_size"))
    offsets = sizes.selectExpr("_source", "_bucket AS _at", "coalesce(sum(_size) OVER (PARTITION BY _source ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset").withColumnRenamed("_source", "_of")
    dealt = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_turns") - 1))).drop("_turns")
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY _source, _bucket, _turn ORDER BY _h, _tie) - 1 AS _k")
    placed = numbered.join(offsets, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_at"))).withColumn("_k", F.col("_k") + F.col("_offset"))
    placed = placed.join(near(plan.drop("_turns")), F.col("_source").eqNullSafe(F.col("_s")))
    every = placed.selectExpr("_row", "_k", "_n", "_p", "_slots", f"explode(filter(sequence(_turn * {EPOCHS}, _turn * {EPOCHS} + {EPOCHS - 1}), e -> _k + e * _n < _room)) AS _epoch")
    every = every.withColumn("_x", F.expr("_k + _epoch * _n")).withColumn("_i", F.expr(f"_x DIV {block}"))
    out = every.selectExpr("_row", f"((_i DIV _p) * {quanta} + element_at(_slots, CAST(_i % _p AS INT) + 1)) * {block} + _x % {block} AS _position", "_epoch")
    gone = {position.lower(), epoch.lower()}
    return out.select(*(F.col("_row")[c].alias(c) for c in names if c.lower() not in gone), F.col("_position").alias(position), F.col("_epoch").alias(epoch)), length * block


def in_order(mixed: DataFrame, rows: int, position: str = "position") -> DataFrame:
    """A mix in the order of its places over as many partitions as the session shuffles to; rows is its length, so no sample is needed."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-rows // parts))
    return mixed.repartitionById(parts, (q(position) / each).cast("int")).sortWithinPartitions(position)
