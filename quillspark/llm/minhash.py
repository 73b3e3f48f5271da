"""Near duplicates by DartMinHash.

A text is the set of its shingles: SHINGLE lower-cased words in a row (a text of fewer words is one shingle of them all). Each
shingle has a weight, 1 by default. Its region, the weight by the rank axis, is filled with a Poisson process of darts that depend
on the shingle alone: gaps between ranks come from a hash of shingle, slab of weight (0-1, 1-2, 2-4, ...) and number of the dart. A text
sees the darts under its weights up to a rank at which about k (ln k + 2) darts are expected, and twice that while a coordinate
is empty. A dart has a hashed coordinate of k; the earliest dart in each coordinate is the signature's entry. Two texts agree in an
entry with the probability of their weighted Jaccard similarity.

Signatures are cut into BANDS of ROWS entries; texts that share a band are candidates. At a similarity of 0.8 the chance that no band is shared
is (1 - 0.8^5)^30 < 7e-6. Exact similarity of the shingle sets (32-bit hashes) decides on candidates:

- A band of at most BLOCK texts (and BLOCK_SHINGLES shingles) is one block, a larger one is dealt into several; bands that hold the same texts are one. Inside a block
  components grow from a text at a time: whatever joins is compared with all that have not joined yet, so in the end any two texts of a block are
  connected by links or were compared. A task holds one block; what leaves it is a link for each text that joined, not pairs.
- Then components are built over all blocks. In a band of several blocks that still holds more than one component, every text outside of the band's largest component is
  compared with all texts of other components there, block by block.

So every candidate pair is compared, or its texts are connected by other links: nothing is capped, and no link of two candidates is lost. The second step takes a
time in proportion to (texts outside of the largest component) x (texts) of each such band; where a crowd of texts is alike but not alike enough, that is the square of it.

Identical texts are one class whatever they hold (null counts as empty); they are collapsed before anything else. Texts without words link to
identical texts only; texts of fewer than five words are one shingle. Texts of any length are read whole. Of ties between ids the smallest stands for a class; repeated rows
belong to its class each. Only key and text are read, so other columns may have any names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, prepare, q, texts_of, written

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 30, 5
#: Texts and shingles of a block at most.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Rows that make a task worth its while.
ROWS_A_TASK = 20_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def word_characters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out[np.frombuffer("".join(regex.findall(r"[\p{L}\p{M}\p{N}_]+", every)).encode("utf-32-le"), np.uint32)] = True
    return out


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text in order, with repeats, and where each text's begin (and the end)."""
    low = [t.lower() + "\n" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    inside = word_characters()[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(inside)
    lengths = past - first
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = mix(codes[at].astype(U) << U(32) | place.astype(U))
    words = mix(np.add.reduceat(parts, np.cumsum(lengths) - lengths))
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])  # words of each text
    n = np.diff(bounds)
    out_n = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    starts = np.concatenate([[0], np.cumsum(out_n)])
    own = np.repeat(np.arange(len(texts)), out_n)
    begin = bounds[own] + np.arange(starts[-1]) - starts[own]
    out = np.zeros(starts[-1], U)
    for j in range(size):
        has = j < n[own]
        factor = U((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
        out[has] += mix(words[begin[has] + j] * factor)
    return mix(out), starts


def elements(texts: list[str], size: int = SHINGLE, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights (1 for "set", occurrences for "count") and where each text's begin."""
    hashes, starts = shingle_hashes(texts, size)
    found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    at = np.concatenate([[0], np.cumsum([len(x) for x, _ in found], dtype=np.int64)]).astype(np.int64)
    items = np.concatenate([x for x, _ in found]) if found else np.zeros(0, U)
    n = np.concatenate([c for _, c in found]).astype(float) if found else np.zeros(0)
    return items, n if weights == "count" else np.ones(len(items)), at


def signatures(items: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The signature of each weighted set items[at[i]:at[i+1]]; zeros for an empty set."""
    n = len(at) - 1
    out = np.zeros((n, k), U)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    total = np.bincount(owner, weights, n)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[todo] = k * (np.log(k) + 2) / total[todo]
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), bool)
        item, weight, own = items[mine], weights[mine], owner[mine]
        low, high, slab = np.zeros(len(item)), np.ones(len(item)), 0
        best = np.full(n * k, np.inf)
        darts = []
        while len(item):  # a slab of weight
            state, width, rank = mix(item + U(slab * 0x632BE59BD9B4E019 % 2**64)), high - low, np.zeros(len(item))
            w, o, lo = weight, own, low
            while len(state):  # the next dart of each
                state = state + U(0x9E3779B97F4A7C15)
                dart = mix(state)
                rank = rank - np.log((dart >> U(11)).astype(float) * 2.0**-53 + 2.0**-54) / width
                live = rank < limit[o]
                if not live.all():
                    state, rank, width, w, o, lo, dart = state[live], rank[live], width[live], w[live], o[live], lo[live], dart[live]
                other = mix(dart ^ U(0xD1B54A32D192ED03))
                inside = lo + width * ((other & U(0xFFFFFFFF)).astype(float) * 2.0**-32) < w
                key = o * k + ((other >> U(32)) % U(k)).astype(np.int64)
                key, r, dart = (key, rank, dart) if inside.all() else (key[inside], rank[inside], dart[inside])
                np.minimum.at(best, key, r)
                darts.append((key, r, dart))
            more = weight > high
            item, weight, own, low, high, slab = item[more], weight[more], own[more], high[more], 2 * high[more], slab + 1
        flat = out.reshape(-1)
        for key, r, dart in darts:
            first = r == best[key]
            flat[key[first]] = dart[first]
        empty = np.isinf(best.reshape(n, k)[todo]).any(1)
        todo = todo[empty]
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of each signature."""
    parts = signature[:, : bands * rows].reshape(-1, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(U)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.astype(np.int64)


def bands_of(text: Column, size: int, bands: int, rows: int, weights: str) -> Column:
    """The keys of a text's bands (null for a text without words) and the size of its set."""
    kind = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])

    @F.arrow_udf(kind)
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = []
            sizes: list = []
            for piece in pieces(batch):
                items, w, at = elements(texts_of(piece), size, weights)
                found = band_keys(signatures(items, w, at, bands * rows), bands, rows)
                out += [x if full else None for x, full in zip(found, np.diff(at) > 0, strict=True)]
                sizes += np.diff(np.concatenate([[0], np.cumsum(w)])[at]).astype(np.int64).tolist()
            yield pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["keys", "size"])

    return keys(text)


def sets_of(text: Column, size: int, weights: str) -> Column:
    """Shingles as a sorted array of 32-bit hashes; with weights "count" the j-th occurrence of a shingle is a member of its own."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for piece in pieces(batch):
                items, w, at = elements(texts_of(piece), size, weights)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    x = items[a:b]
                    if weights == "count":
                        n = w[a:b].astype(np.int64)
                        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        x = mix(np.repeat(x, n) + turn.astype(U) * U(0xA24BAED4963EE407))
                    out.append(np.unique((x >> U(32)).astype(np.uint32).view(np.int32)))
            yield pa.array(out, pa.list_(pa.int32()))

    return members(text)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in fewer partitions if so few rows (a measured number) leave the session's number of them nearly empty."""
    parts = max(1, -(-rows // ROWS_A_TASK))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (a, b). Labels spread to neighbours and jump along labels."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")), f"{name}-edges")
    rows = both.count()
    labels = written(sized(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), rows).select("node", F.least("node", "label").alias("label")), f"{name}-labels")
    while True:
        near = sized(both.join(labels.withColumnRenamed("node", "b"), "b"), rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = sized(labels.join(near, "node"), rows).select("node", "label", F.least("label", "near").alias("next"))
        once = written(once, f"{name}-labels")
        jump = once.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        new = written(sized(once.join(jump, "next"), rows).select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") != F.col("label")).alias("changed")), f"{name}-labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels


def common_with(x: np.ndarray, mark: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many members of x each of several sets has; the sets stand in flat one after another."""
    mark[x] = 1
    out = np.add.reduceat(mark[flat], starts, dtype=np.int64)
    mark[x] = 0
    return out


def joined_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the first one of its component, in which sets are linked that reach the threshold."""
    n = len(sets)
    root, size = np.arange(n), np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        root[1] = 0 if common >= threshold * (size.sum() - common) else 1
        return root
    members, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(size)[:-1])
    mark, left = np.zeros(len(members), np.uint8), np.arange(n)
    while len(left) > 1:
        seed, left = left[0], left[1:]
        todo, held = [seed], None
        while todo and len(left):
            x = todo.pop()
            if held is None:
                held = np.concatenate([parts[i] for i in left]), np.cumsum(size[left]) - size[left]
            common = common_with(parts[x], mark, *held)
            near = common >= threshold * (size[x] + size[left] - common)
            if near.any():
                root[left[near]] = seed
                todo += left[near].tolist()
                left, held = left[~near], None
    return root


def links_between(sets: list[np.ndarray], labels: list, asks: list[bool], threshold: float) -> list[tuple[int, int]]:
    """Links of the sets that ask with sets of other labels, enough to connect what is connected."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    members, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark = np.cumsum(size) - size, np.zeros(len(members), np.uint8)
    parts, own = np.split(flat, starts[1:]), np.unique(np.array(labels, object), return_inverse=True)[1]
    out = []
    for x in np.flatnonzero(asks).tolist():
        common = common_with(parts[x], mark, flat, starts)
        for y in np.flatnonzero((common >= threshold * (size[x] + size - common)) & (own != own[x])).tolist():
            if own[x] != own[y]:
                out.append((x, y))
                own[own == own[y]] = own[x]
    return out


def blocks_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The columns of each block of rows that agree in the keys, as lists (sets as arrays); rows come sorted by the keys."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        columns = {}
        for name in batch.schema.names:
            if name == "set":
                lists = batch.column(name)
                columns[name] = np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
            elif name not in keys:
                columns[name] = batch.column(name).to_pylist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[a].tolist())
            if held and now != last:
                yield held
                held = {}
            last = now
            for name, values in columns.items():
                held.setdefault(name, []).extend(values[a:b])
    if held:
        yield held


def text_node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def links_across(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components in bands of several blocks, members (band, parts, node, size). In each band all texts outside of its largest component ask all texts of others."""
    own = written(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "minhash-crowd")
    held = own.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    band = held.groupBy("band").agg(F.max(F.struct("n", "label", "weight")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    turns = F.ceil(F.greatest((F.col("n") - F.col("main.n")) / BLOCK, (F.col("weight") - F.col("main.weight")) / BLOCK_SHINGLES))
    open_ = band.where(F.col("n") > F.col("main.n")).select("band", F.col("main.label").alias("main"), turns.alias("turns"))
    rows = own.join(open_, "band").join(sets, "node")
    block, turn = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")), F.pmod(F.xxhash64("node", F.lit(3)), F.col("turns"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    listed = F.transform(upto("turns"), lambda t: F.struct(block.cast("long").alias("block"), t.alias("turn"), F.lit(False).alias("asks")))
    asking = F.when(F.col("label") != F.col("main"), F.transform(upto("parts"), lambda b: F.struct(b.alias("block"), turn.cast("long").alias("turn"), F.lit(True).alias("asks")))).otherwise(F.slice(listed, 1, 0))
    dealt = rows.select("band", "node", "label", "set", F.explode(F.concat(listed, asking)).alias("p")).select("band", "p.block", "p.turn", "p.asks", "node", "label", "set")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in blocks_of(batches, ("band", "block", "turn")):
            pairs = links_between(found["set"], found["label"], found["asks"], threshold)
            if pairs:
                yield pa.record_batch({k: pa.array([found["node"][p[i]] for p in pairs], pa.binary()) for i, k in enumerate("ab")})

    order = ("band", "block", "turn")
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(links, "a binary, b binary").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """A row for each distinct text: node (its md5), rep (its smallest id, nulls first), rep_rows (rows with that id and text), n_rows, class_id
    (the smallest id of its class) and keeper (whether it is the text that stands for its class: of those with the smallest id the one with the smallest md5).
    """
    prepare(docs.sparkSession)
    base = docs.select(q(key).alias("id"), q(text).alias("text")).withColumn("node", text_node(F.col("text")))
    signed = base.select("node", "id", bands_of(F.col("text"), size, bands, rows, weights).alias("bands"))
    per_id = signed.groupBy("node", "id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"))
    reps = per_id.groupBy("node").agg(F.min(F.struct("id", "n")).alias("low"), F.min("id").alias("least_id"), F.sum("n").alias("n_rows"), F.first("bands").alias("bands"))
    reps = written(reps.select("node", F.col("low.id").alias("rep"), F.col("low.n").alias("rep_rows"), "least_id", "n_rows", "bands"), "minhash-texts")

    every = reps.select("node", F.col("bands.size").alias("size"), F.explode("bands.keys").alias("band"))
    # Bands of the same texts are one: their number and two hashes of 64 bits over all of them tell.
    shared = every.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("low.weight") / BLOCK_SHINGLES))
    distinct = shared.groupBy("n", "h", "g").agg(F.min(F.struct("band", "weight")).alias("low")).select("low.band", parts.alias("parts"))
    members = written(every.join(distinct, "band"), "minhash-members")
    rows_, most = members.agg(F.count("*"), F.max("parts")).first()
    labels = None
    if rows_:
        candidates = members.select("node").distinct().join(reps.select("node", "rep"), "node")
        texts = base.join(candidates.withColumnRenamed("node", "c"), (F.col("node") == F.col("c")) & F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")
        sets = written(texts.select("node", sets_of(F.col("text"), size, weights).alias("set")).groupBy("node").agg(F.first("set").alias("set")), "minhash-sets")
        block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in blocks_of(batches, ("band", "block")):
                root = joined_sets(found["set"], threshold)
                some = np.flatnonzero(root != np.arange(len(root))).tolist()
                if some:
                    yield pa.record_batch({"a": pa.array([found["node"][root[i]] for i in some], pa.binary()), "b": pa.array([found["node"][i] for i in some], pa.binary())})

        blocks = members.join(sets, "node").select("band", block.alias("block"), "node", "set")
        near = written(blocks.repartition("band", "block").sortWithinPartitions("band", "block").mapInArrow(links, "a binary, b binary").distinct(), "minhash-links")
        labels = components(near, "minhash")
        if most > 1:
            more = written(links_across(members.where("parts > 1"), labels, sets, threshold), "minhash-links")
            if not more.isEmpty():
                # These join components found so far: their labels are the nodes of a smaller graph.
                ends = more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
                merged = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), "minhash")
                moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                labels = written(moved.unionByName(merged.join(labels, "node", "left_anti").select("node", "label")), "minhash-labels")
    if labels is None:
        out = reps.withColumn("class_id", F.col("least_id")).withColumn("keeper", F.lit(True))
        return out.drop("bands", "least_id")
    linked = reps.drop("bands").join(labels, "node")
    least = linked.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min(F.struct("rep", "node")).alias("low"))
    linked = linked.join(least, "label").withColumn("keeper", F.col("node") == F.col("low.node")).drop("low", "label")
    alone = reps.drop("bands").join(labels, "node", "left_anti").withColumn("class_id", F.col("least_id")).withColumn("keeper", F.lit(True))
    return written(linked.unionByName(alone).drop("least_id"), "minhash-classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each row of docs: its id, the class it belongs to (the smallest id in it; null only if all ids in it are) and the class's number of rows."""
    found = classes(docs, key, text, **how)
    sizes = found.groupBy("class_id").agg(F.sum("n_rows").alias("class_rows"))
    found = found.select("node", "class_id").join(sizes.withColumnRenamed("class_id", "c"), F.col("class_id").eqNullSafe(F.col("c"))).drop("c")
    rows = docs.select(q(key).alias(key), text_node(q(text)).alias("node"))
    return rows.join(found, "node").select(q(key), "class_id", "class_rows")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each class: the smallest id's. Of rows that share id and text one stays."""
    found = classes(docs, key, text, **how)
    keep = found.where("keeper").select(F.col("node").alias("_quill_node"), F.col("rep").alias("_quill_rep"), "rep_rows")
    rows = docs.withColumn("_quill_at", text_node(q(text)))
    kept = rows.join(keep, (F.col("_quill_at") == F.col("_quill_node")) & q(key).eqNullSafe(F.col("_quill_rep")))
    if not keep.where("rep_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["_quill_node"])
    return kept.select(*(q(c) for c in docs.columns))
