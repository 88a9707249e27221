"""MinHash near-deduplication with min-max hashing (operator 6).

A document's set holds the hashes of its distinct word shingles. Each of ``PERMUTATIONS``
permutations keeps both the smallest and the largest value, so 64 hash evaluations give 128
signature values; 32 bands of 4 (16 of minima, 16 of maxima) make candidates. At a
similarity of 0.8 a pair shares no band with probability (1 - 0.8**4)**32 = 5e-8.

Documents of equal sets are one node from the start (a group of copies costs one aggregation).
Nodes that share a band bucket are compared by their full sets, in two steps that emit no
pairs of a group. First every node is compared with one leader (of the best connected nodes
of its buckets the best one), which joins nearly all near copies at a cost of one pair a node;
as a leader ranks above its followers, the links form trees, whose roots come by pointer
jumping. Then the buckets that still hold several trees are checked completely: the nodes
outside a bucket's largest tree are compared with all nodes of other trees, in tiles of
bounded size (blocks of about ``BLOCK_TOKENS`` shingles), where 32-bit shingle hashes give the
intersections and only pairs near the threshold leave a tile, to be confirmed on the full
sets. So no pair of different
components that shares a bucket is left out, and a group of n near copies costs n pairs.

Defined cases: null, empty and blank texts have an empty set and stand alone; fewer words
than a shingle make one shingle of them all; rows with a null doc_id link with nothing, get a
null component and are kept; rows that repeat a doc_id count as one document, which links by any of
its texts and so joins what each of them is similar to; ties go to the smaller doc_id; an empty table gives
an empty result; extra columns are ignored; a very long text is hashed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import U64, mix, word_hashes, written

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
SIMILARITY = 80  # per cent
SHINGLE = 5
#: Shingles in a block of nodes; bounds what a task holds.
BLOCK_TOKENS = 500_000
#: Per cent under the threshold at which 32-bit hashes still count as a candidate.
SLACK = 2

_RNG = np.random.Generator(np.random.PCG64(20240611))
_A = (_RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << U64(1)) | U64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word-hash sequence."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, U64)
    for j in range(min(k, len(words))):
        h = mix(h, j + 1) + words[j : j + n] * U64(0x9E3779B97F4A7C15)
    return np.unique(mix(h, len(words) if len(words) < k else 0))


def signature(s: np.ndarray) -> np.ndarray:
    """The band keys of a set: minima and maxima of each permutation, hashed by fours."""
    step = 1 << 14  # a long set is taken in pieces
    lo, hi = np.full(PERMUTATIONS, ~U64(0)), np.zeros(PERMUTATIONS, U64)
    for i in range(0, len(s), step):
        v = _A[:, None] * s[None, i : i + step] + _B[:, None]
        np.minimum(lo, v.min(axis=1), out=lo)
        np.maximum(hi, v.max(axis=1), out=hi)
    rows = np.concatenate([lo, hi]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key, j + 1) ^ mix(rows[:, j], 77)
        key = key * U64(0x9E3779B97F4A7C15)
    return mix(key)


def _key(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a whole set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, k1, k2, bands, at = [], [], [], [], [0]
            for w in word_hashes(b.column(1)):
                s = shingle_set(w, k)
                size.append(len(s))
                for col, v in zip((k1, k2), _key(s)):
                    col.append(v)
                if len(s):
                    bands.append(signature(s))
                at.append(at[-1] + (BANDS if len(s) else 0))
            flat = np.concatenate(bands) if bands else np.empty(0, U64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), _longs(flat))],
                ["doc_id", "n", "k1", "k2", "bands"])

    return run


def _sets(k: int):
    """(doc_id, text, k1, k2) to (node, shingles) for the rows whose set is the one of k1, k2; of
    equal neighbours only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            nodes, sets, size = [], [], 0
            ids, keys = b.column(0).to_pylist(), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            for i, w in enumerate(word_hashes(b.column(1))):
                s = shingle_set(w, k)
                if (ids[i], keys[i]) != last and _key(s) == keys[i]:
                    last = ids[i], keys[i]
                    nodes.append(ids[i])
                    sets.append(s)
                    size += len(s)
                if nodes and (size > 1 << 20 or i == len(ids) - 1):  # 8 MB of sets at a time
                    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(at), _longs(np.concatenate(sets)))], ["node", "shingles"])
                    nodes, sets, size = [], [], 0

    return run


# --- connected components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the undirected edges (a, b): comp is the smallest node reachable.

    Alternating star operations: every node links its larger neighbours to its smallest one,
    then its smaller neighbours and itself. Stars take two rounds, a chain of length n about
    log n. Joins and aggregations on the node only, each round written to shared storage."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc")
    mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = written(small.where("u > v").distinct(), "cc")
        was, mark = mark, e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) by pointer jumping: a tree of depth d takes log d rounds."""
    p = written(parents, "parents")
    while True:
        q = p.select(F.col("node").alias("q"), F.col("parent").alias("up"))
        p = written(p.join(q, F.col("parent") == F.col("q"), "left").select(
            "node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), "parents")
        if not p.where("moved").limit(1).count():
            return p.select("node", F.col("parent").alias("root"))
        p = p.drop("moved")


# --- candidate search -------------------------------------------------------------------


def _linked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * per_cent).select("a", "b")


def _sizes_fit(x: Column, y: Column, per_cent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * per_cent


def _tile_candidates(members: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of nodes of different components that share a bucket and are similar up to ``SLACK``.

    In a bucket the core is its largest component, the rest all other nodes. Rest and core are
    dealt into blocks by hash; tile (k, -1 - c) holds rest block k (left) and core block c
    (right) and for c = 0 also compares the rest block with itself; tile (k, l) holds two rest
    blocks k < l."""
    each = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    shape = each.groupBy("bucket").agg(
        F.max(F.struct(F.col("c"), (-F.col("comp")).alias("neg"), F.col("t"))).alias("core"), F.sum("t").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda t: F.ceil(t / F.lit(BLOCK_TOKENS)).cast("int")
    shape = shape.select(
        F.col("bucket").alias("sb"), (-F.col("core.neg")).alias("core"), blocks(F.col("core.t")).alias("cores"), blocks(F.col("all") - F.col("core.t")).alias("rests"))
    m = members.join(shape, F.col("bucket") == F.col("sb"))
    in_core = F.col("comp") == F.col("core")
    block = F.pmod(F.xxhash64("node"), F.when(in_core, F.col("cores")).otherwise(F.col("rests"))).cast("int")
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    tile = lambda k, x, right: F.struct(k.cast("int").alias("k"), x.cast("int").alias("l"), F.lit(right).alias("right"))
    own, zero, one = F.col("block"), F.lit(0), F.lit(1)
    as_core = F.transform(upto(zero, F.col("rests") - one), lambda k: tile(k, -1 - own, True))
    as_rest = F.concat(
        F.transform(upto(zero, F.col("cores") - one), lambda c: tile(own, -1 - c, False)),
        F.transform(upto(own + one, F.col("rests") - one), lambda x: tile(own, x, False)),
        F.transform(upto(zero, own - one), lambda x: tile(x, own, True)))
    m = m.withColumn("block", block).select("bucket", "node", "comp", F.explode(F.when(in_core, as_core).otherwise(as_rest)).alias("t"))
    short = sets.select(F.col("node").alias("sn"), F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("tokens"))
    rows = m.join(short, F.col("node") == F.col("sn")).select(
        "bucket", F.col("t.k").alias("k"), F.col("t.l").alias("l"), F.col("t.right").alias("right"), "node", "comp", "tokens")
    return rows.repartition("bucket", "k", "l").sortWithinPartitions("bucket", "k", "l").mapInArrow(_tiles(per_cent - SLACK), "a long, b long")


def _tile_links(right: np.ndarray, node: np.ndarray, comp: np.ndarray, flat: np.ndarray, size: np.ndarray, within: bool, per_cent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a tile's rows (left with right, and left with left if ``within``) of different
    components whose token sets are similar to ``per_cent``."""
    _, token = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(flat), np.int32)
    for y in np.flatnonzero(~right):
        other = comp != comp[y]
        other &= right | ((np.arange(len(node)) > y) if within else False)
        other &= np.minimum(size, size[y]) * 100 >= np.maximum(size, size[y]) * per_cent
        if not other.any():
            continue
        own = token[at[y] : at[y + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[token], at[:-1])
        mark[own] = 0
        hit = other & (both * 100 >= (size + size[y] - both) * per_cent)
        for x in np.flatnonzero(hit):
            yield (min(node[x], node[y]), max(node[x], node[y]))


def _tiles(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> list[tuple[int, int]]:
            rows = pa.Table.from_batches(held)
            tokens = rows.column("tokens").combine_chunks()
            tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
            size = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            col = lambda c: rows.column(c).to_numpy()
            return list(_tile_links(
                col("right"), col("node"), col("comp"), tokens.flatten().to_numpy(), size, key[2] == -1, per_cent))

        def out(pairs):
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            pairs = []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    now = tuple(keys[lo].tolist())
                    if held and now != key:
                        pairs += close()
                        held = []
                    key = now
                    held.append(b.slice(lo, hi - lo))
            yield out(pairs)
        if held:
            yield out(close())

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(docs.mapInArrow(_sign(shingle), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    nodes = written(base.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "nodes")

    # one row per node and band; nodes alone in a bucket drop out
    key = nodes.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "node")
    band = base.where("n > 0").join(key, F.expr("k1 = r1 and k2 = r2 and doc_id = node")).select(
        "node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    counts = band.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = written(band.join(counts.where("lo < hi").select("bucket", "c"), "bucket"), "buckets")
    rank = shared.groupBy("node").agg(F.sum("c").alias("prio"))
    members = written(shared.drop("c").join(rank, "node"), "members")
    wanted = members.select("node").distinct().join(key, "node").withColumnRenamed("node", "wanted")
    sets = written(
        docs.join(wanted, F.col("doc_id") == F.col("wanted")).select("doc_id", "text", "r1", "r2")
        .mapInArrow(_sets(shingle), "node long, shingles array<long>"), "shingles")

    # every node and the best leader of its buckets; a leader ranks above the node in (prio, -id)
    lead = members.groupBy("bucket").agg(F.max(F.struct("prio", (-F.col("node")).alias("neg"), "n")).alias("l")).withColumnRenamed("bucket", "lb")
    pick = members.join(lead, F.col("bucket") == F.col("lb")).where((F.col("node") != -F.col("l.neg")) & _sizes_fit(F.col("n"), F.col("l.n"), per_cent))
    pairs = pick.groupBy("node").agg(F.max("l").alias("l")).select(F.col("node").alias("a"), (-F.col("l.neg")).alias("b"))
    links = _linked(pairs, sets, per_cent).groupBy("a").agg(F.max("b").alias("b"))
    tree = written(roots(links.select(F.col("a").alias("node"), F.col("b").alias("parent"))), "roots")

    # what shares a bucket across trees; then components of the trees
    placed = members.select("bucket", "node", "n").join(tree.withColumnRenamed("node", "t"), F.col("node") == F.col("t"), "left")
    placed = written(placed.select("bucket", "node", "n", F.coalesce("root", "node").alias("comp")), "placed")
    # rows of one document with different sets tie their nodes together
    again = base.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("again"))
    again = written(base.join(again, F.col("doc_id") == F.col("again")).select("again", "n", "k1", "k2").distinct(), "repeated")
    again = again.join(nodes.withColumnsRenamed({"k1": "r1", "k2": "r2"}), (F.col("n") > 0) & (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    again = written(again.select("again", F.coalesce("node", "again").alias("node")), "repeated-nodes")
    least = again.groupBy("again").agg(F.min("node").alias("b")).withColumnRenamed("again", "of")
    ties = again.join(least, F.col("again") == F.col("of")).where("node > b").select(F.col("node").alias("a"), "b").distinct()
    found = written(_linked(_tile_candidates(placed, sets, per_cent).distinct(), sets, per_cent).unionByName(ties), "links")
    root_of = lambda c: tree.select(F.col("node").alias(f"{c}_n"), F.col("root").alias(f"{c}_r"))
    found = found.join(root_of("a"), F.col("a") == F.col("a_n"), "left").join(root_of("b"), F.col("b") == F.col("b_n"), "left")
    merged = written(components(found.select(F.coalesce("a_r", "a").alias("a"), F.coalesce("b_r", "b").alias("b"))), "merged")
    # members of a tree and its root, then the group that the root's component makes
    whole = tree.unionByName(tree.select(F.col("root").alias("node"), "root")).unionByName(
        found.select(F.explode(F.array(F.coalesce("a_r", "a"), F.coalesce("b_r", "b"))).alias("node")).withColumn("root", F.col("node"))).distinct()
    whole = written(whole.join(merged.withColumnRenamed("node", "mn"), F.col("root") == F.col("mn"), "left").select(
        "node", F.coalesce("comp", "root").alias("group")), "groups")
    least = whole.groupBy("group").agg(F.min("node").alias("comp")).withColumnRenamed("group", "g")
    comp = whole.join(least, F.col("group") == F.col("g")).select("node", "comp")

    out = base.join(nodes.withColumnsRenamed({"k1": "r1", "k2": "r2"}), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    out = out.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id")))
    out = out.join(comp.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left")
    comp_id = F.coalesce("comp", "node")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.col("doc_id").eqNullSafe(comp_id).alias("kept"))


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, all columns unchanged. Of rows that
    repeat a doc_id, each stays if the id does."""
    found = near_duplicates(docs, shingle, per_cent)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
