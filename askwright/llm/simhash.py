"""SimHash fingerprints and exact near-duplicate links through sharded vantage-point trees.

Fingerprints are made once per document and made distinct, so a group of copies is one point.  A vantage-point tree
built on a bounded sample of the points splits the space: a point lives in one shard (home) and visits each shard whose
region may hold a point within the limit, by the triangle bounds |d(q, v) - d(m, v)| <= d(q, m).  Inside a shard a
deeper tree prunes by the same bounds and the remaining leaves are compared exactly.  What a shard's points and visitors ask
is dealt into blocks, each with all points of the shard: a task's work does not grow with the visitors.  A block returns one
edge for each point that it links to another (a forest, never the pairs), and the forests are joined into components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import discard, materialize, partitions, slices

LIMIT = 4
SHINGLE = 4
SEED = 42
SHARD_POINTS = 65536  # home points of a shard, about: a shard stays within a few MB, and fewer shards mean fewer visits
MOST_SHARDS = 1 << 16  # beyond 4e9 distinct fingerprints shards grow: at 1e11 they hold some 1.5 million points, 30 MB
SAMPLE = 16  # points of the sample for each shard; it shapes the shards, never the result
ASK_POINTS = 16384  # what a block asks, at least; or twice what its shard holds, so that few points stand in several blocks
LEAF_POINTS = 96  # below this a tree node is compared point by point
BLOCK = 1 << 21  # distances held at once


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six white bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends)), np.uint64, len(begins))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """Rows (id, fp), or (id, key, fp): fp is the fingerprint as a signed long.  A null text counts as empty."""
    more = [] if key is None else ["key"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.fromiter(map(fingerprint, part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(fps.view(np.int64))], ["__id", *more, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *[key.alias("key") for _ in more])
    return rows.mapInArrow(run, "__id long, " + "".join(f"{c} binary, " for c in more) + "fp long")


# ---- vantage-point trees ---------------------------------------------------------------------------------------


def distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v)


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point, of a few tried, whose distances spread most, and their median as radius."""
    best = None
    seen = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    for v in points[rng.integers(0, len(points), 6)]:
        d = distance(seen, v)
        radius = int(np.median(d))
        if radius >= d.max():
            radius = int(d.max()) - 1
        if radius < int(d.min()):
            continue
        spread = float(d.std())
        if best is None or spread > best[0]:
            best = (spread, v, radius)
    return None if best is None else best[1:]


def build_top(sample: np.ndarray, depth: int) -> list:
    """Nested [v, radius, near, far]; a leaf is its shard number."""
    rng, shards = np.random.default_rng(7), [0]

    def node(points: np.ndarray, left: int):
        cut = split(points, rng) if left and len(points) > 8 else None
        if cut is None:
            shards[0] += 1
            return shards[0] - 1
        v, radius = cut
        near = distance(points, v) <= radius
        return [v, radius, node(points[near], left - 1), node(points[~near], left - 1)]

    return [node(sample, depth), shards[0]]


def visits(tree, points: np.ndarray, limit: int):
    """Yield (shard, indexes, home) for all points of an array."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, idx, home = stack.pop()
        if not len(idx):
            continue
        if isinstance(node, int):
            yield node, idx, home
            continue
        v, radius, near, far = node
        d = distance(points[idx], v).astype(np.int64)
        inside = d <= radius
        # of two home points on either side of the boundary, the far one visits: one visit finds the pair
        a = d - limit <= radius
        b = ~inside | (~home & (d + limit > radius))
        stack.append((near, idx[a], home[a] & inside[a]))
        stack.append((far, idx[b], home[b] & ~inside[b]))


class Forest:
    """Labels of points: the least position that a point is linked to, by vectorised hooking."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (deeper := label[label] != label).any():
                label[deeper] = label[label[deeper]]


def search(points: np.ndarray, members: np.ndarray, asking: np.ndarray, limit: int, forest: Forest) -> None:
    """Link every asking point with every member within the limit (positions in points); members may ask, too.

    A node holds members and those who ask.  Of two members on either side of its boundary the far one visits the near side;
    visitors go to each side that their distance allows.
    """
    rng = np.random.default_rng(11)
    asks, is_member = np.zeros(len(points), bool), np.zeros(len(points), bool)
    asks[asking], is_member[members] = True, True
    stack = [(members, asking[~is_member[asking]])]
    while stack:
        m, q = stack.pop()
        if not len(m):
            continue
        own = asks[m]
        if not len(q) and not own.any():
            continue
        cut = split(points[m], rng) if len(m) > LEAF_POINTS else None
        if cut is None:
            q = np.concatenate([m[own], q])
            step = max(1, BLOCK // len(m))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[m][None, :]) <= limit)
                a, b = some[i], m[j]
                keep = a != b
                forest.link(a[keep], b[keep])
            continue
        v, radius = cut
        of_m = distance(points[m], v).astype(np.int64)
        near = of_m <= radius
        of_q = distance(points[q], v).astype(np.int64)
        stack.append((m[near], np.concatenate([q[of_q - limit <= radius], m[own & ~near & (of_m - limit <= radius)]])))
        stack.append((m[~near], q[of_q + limit > radius]))


def shard_edges(rows: pd.DataFrame, limit: int = LIMIT) -> pd.DataFrame:
    """rows: fp, rep, home, asks.  One edge (a, b), b < a, for each point linked here to another: b is the least of its tree."""
    rows = rows.sort_values("rep", kind="stable")
    points = rows["fp"].to_numpy(np.int64).view(np.uint64)
    forest = Forest(len(points))
    search(points, np.flatnonzero(rows["home"].to_numpy(bool)), np.flatnonzero(rows["asks"].to_numpy(bool)), limit, forest)
    rep = rows["rep"].to_numpy(np.int64)
    linked = np.flatnonzero(forest.label != np.arange(len(points)))
    return pd.DataFrame({"a": rep[linked], "b": rep[forest.label[linked]]})


# ---- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge; root is the least node reachable.  Alternating large and small stars.

    Each round is a written table: lineage stays short and lost executors cost one round.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, now = now, materialize(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(now)
        for path in last.inputFiles()[:1]:
            discard(now.sparkSession, path.rsplit("/", 1)[0])  # the round before: nothing reads it again
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Fingerprints at `limit` or fewer differing bits are linked; equal ones always are, those of empty texts (0) too.
    Null text counts as empty.  A row with a null id gets its fingerprint, and the component of the ids that share it
    (null if none does), but links nothing.  Repeated rows are repeated, long texts are read whole, an empty table gives an
    empty result; other columns are ignored.
    """
    found = classes(fingerprints(docs, id_col, text_col), limit)
    return found.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(fingerprinted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of fingerprints() with the component_id of their fingerprint."""
    made = materialize(fingerprinted, "fingerprints")
    points = materialize(made.groupBy("fp").agg(F.min("__id").alias("rep")).where("rep is not null"), "points")
    total = points.count()
    depth = min(max(0, math.ceil(math.log2(max(1, total) / SHARD_POINTS))), int(math.log2(MOST_SHARDS)))
    # a share by hash, of about SAMPLE << depth points: no sort, nothing merged on the driver, the same in every run
    share = int((1 << 30) * min(1.0, (SAMPLE << depth) / max(1, total)))
    sample = [r[0] for r in points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).collect()] if depth else []
    tree, shards = build_top(np.sort(np.array(sample, np.int64)).view(np.uint64), depth) if depth else (0, 1)
    held = points.sparkSession.sparkContext.broadcast(tree)

    def count(batches):
        sums = np.zeros((2, shards), np.int64)
        for batch in batches:
            for shard, idx, home in visits(held.value, batch.column(0).to_numpy().view(np.uint64), limit):
                sums[0, shard] += home.sum()
                sums[1, shard] += len(idx)
        found = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums[0, found]), pa.array(sums[1, found])], ["shard", "home", "n"])

    # home points and askers of each shard: one row a shard
    sizes = points.select("fp").mapInArrow(count, "shard int, home long, n long").groupBy("shard").agg(F.sum("home"), F.sum("n")).collect() if depth else [(0, total, total)]
    blocks = np.ones(shards, np.int64)
    for shard, home, n in sizes:
        blocks[shard] = max(1, -(-n // max(ASK_POINTS, 2 * home)))

    def assign(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            rep = batch.column(1).to_numpy()
            own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for shard, idx, home in visits(held.value, fp.view(np.uint64), limit):
                n = int(blocks[shard])
                asked = own[idx] % n
                for block in range(n):  # a home point stands in all blocks of its shard and asks in one; a visitor is in one
                    asks = asked == block
                    here = home | asks
                    if here.any():
                        at = idx[here]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), block, np.int32)), pa.array(fp[at]), pa.array(rep[at]), pa.array(home[here]), pa.array(asks[here])],
                            ["shard", "block", "fp", "rep", "home", "asks"],
                        )

    dealt = points.select("fp", "rep").mapInArrow(assign, "shard int, block int, fp long, rep long, home boolean, asks boolean")
    dealt = dealt.repartition(max(partitions(made), min(int(blocks.sum()), 100_000)), "shard", "block")  # small groups that compute much: not to be put together
    edges = dealt.groupBy("shard", "block").applyInPandas(lambda rows: shard_edges(rows[["fp", "rep", "home", "asks"]], limit), "a long, b long")
    roots = components(edges)
    found = points.join(roots, points["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return made.join(found, "fp", "left")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of docs that stand for their component: of those with its smallest id, the one of the least fingerprint and
    digest.  A row is judged by its own id and text, so the texts of an id with several stay or go each for themselves.  Rows
    with a null id stay; rows repeated whole stay together."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = classes(fingerprints(docs, id_col, text_col, digest), limit)
    stands = found.where("__id = component_id").groupBy("component_id").agg(F.min(F.struct("fp", "key")).alias("first")).select(F.col("component_id").alias("__stands"), "first.key")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), digest.alias("__key"))
    kept = packed.join(stands, (F.col("__id") == F.col("__stands")) & (F.col("__key") == F.col("key")), "left_semi").unionByName(packed.where("__id is null"))
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
