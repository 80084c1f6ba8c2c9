"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 2r share a variant that lies within r of both. So every
distinct fingerprint stands for all its variants within half the radius (2081 at radius 4),
the variants are brought together, and fingerprints that meet in one are linked: both lie
within r of it, hence within 2r of each other, which is checked again on the pair.

The shuffle is by the variants' leading bits (a cell): a fingerprint goes once to each cell
that holds some of its variants, with the flips it has left, and the variants are written
out only there, in blocks of bounded size. Cells that hold far more fingerprints than others,
as those of a large family of near copies do, are split by further bits before the shuffle.
A task takes its cells one after the other; within a cell links become stars on the least
member, so a group of n gives about n links, not n * n.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, map_arrow, n_partitions, row_key, table, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Variants held at once in a task.
BLOCK = 2_000_000
#: Fingerprints that a cell may hold; by how many further bits a larger one is split at a time.
CELL, SPLIT_BITS = 100_000, 4
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text: a bit is 1 if it is set in over half the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, spans, _STEP):
        j = min(i + _STEP, spans)
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > spans).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and fp (the fingerprint as a signed long), one row per row of docs; null texts have fingerprint zero."""
    kept = docs.select(*carry, "text")

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(found)], names=[*carry, "fp"])

    return map_arrow(kept, run, ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in carry), "fp long"]))


def cell_bits(n: int, half: int = RADIUS // 2) -> int:
    """So many leading bits that a cell's share of all variants is about one block; 7 at least."""
    variants = n * sum(math.comb(64, i) for i in range(half + 1))
    return min(24, max(7, math.ceil(math.log2(max(1, variants / BLOCK)))))


def _flips(bits: range, most: int) -> np.ndarray:
    """All masks with at most so many of the given bits."""
    return np.array([sum(1 << b for b in c) for i in range(most + 1) for c in combinations(bits, i)], np.uint64)


def meetings(fps: np.ndarray, left: np.ndarray, free: int, block: int = BLOCK):
    """Pairs (least, other) of indexes of fps that meet in a variant. left: flips that each may still make below bit `free`.

    Too large a set is split by the next bit: either side keeps those that have it, and those
    that can still flip it. A set of fewer than two can't meet.
    """
    if len(fps) < 2:
        return
    most = int(left.max())
    sizes = [math.comb(free, i) for i in range(most + 1)]
    per = np.cumsum(sizes)[left]
    if per.sum() > block and free > most:
        bit = (fps >> np.uint64(free - 1)) & np.uint64(1)
        for side in (0, 1):
            stay = bit == side
            go = stay | (left > 0)
            at = np.flatnonzero(go)
            for a, b in meetings(fps[at], (left - ~stay)[at], free - 1, block):
                yield at[a], at[b]
        return
    low = np.uint64((1 << free) - 1)
    values, owners = [], []
    for r in range(most + 1):
        at = np.flatnonzero(left == r)
        if len(at):
            masks = _flips(range(free), r)
            values.append(((fps[at] & low)[:, None] ^ masks).ravel())
            owners.append(np.repeat(at, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    hit = twice[place] == value
    place, owner = place[hit], owner[hit]
    order = np.lexsort((owner, place))
    place, owner = place[order], owner[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    least = np.repeat(owner[first], np.diff(np.concatenate((first, [len(place)]))))
    pairs = np.unique(np.stack([least, owner], 1)[least != owner], axis=0)
    if len(pairs):
        yield pairs[:, 0], pairs[:, 1]


def _flipped(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for i in range(most + 1) for c in combinations(range(bits), i)]


def cells(nodes: DataFrame, bits: int, radius: int = RADIUS, most: int = CELL) -> DataFrame:
    """(fp, cell, free, flips): nodes(fp) once per cell that holds some of its variants, with the flips left for the `free` bits below.

    Cells of more than `most` are split by SPLIT_BITS at a time until none is, or their bits are used up.
    """
    half = radius // 2
    start = F.array(*[F.struct(F.expr(f"shiftrightunsigned(fp, {64 - bits}) ^ {m}L").alias("cell"), F.lit(half - m.bit_count()).alias("flips")) for m in _flipped(bits, half)])
    rows = nodes.select("fp", F.inline(start)).select("fp", "cell", F.lit(64 - bits).alias("free"), "flips")
    small = None
    while True:
        heavy = written(rows.groupBy("cell", "free").count().where((F.col("count") > most) & (F.col("free") > SPLIT_BITS)).select("cell", "free"), "heavy-cells")
        if heavy.isEmpty():
            return rows if small is None else small.unionByName(rows)
        light = rows.join(heavy, ["cell", "free"], "left_anti").select("fp", "cell", "free", "flips")
        small = light if small is None else small.unionByName(light)
        own = F.expr(f"shiftleft(cell, {SPLIT_BITS}) | (shiftrightunsigned(fp, free - {SPLIT_BITS}) & {(1 << SPLIT_BITS) - 1}L)")
        parts = F.filter(F.array(*[F.struct(own.bitwiseXOR(F.lit(m)).alias("cell"), (F.col("free") - SPLIT_BITS).alias("free"), (F.col("flips") - m.bit_count()).alias("flips")) for m in _flipped(SPLIT_BITS, half)]), lambda x: x["flips"] >= 0)
        rows = written(rows.join(heavy, ["cell", "free"], "left_semi").select("fp", F.inline(parts)), "split-cells")


def links(nodes: DataFrame, bits: int, radius: int = RADIUS, block: int = BLOCK, most: int = CELL) -> DataFrame:
    """nodes(fp), distinct, to stars (a, b) with b < a: what meets within the radius, at most one row per member and cell."""
    dealt = cells(nodes, bits, radius, most).repartition(max(n_partitions(nodes.sparkSession), 1 << max(0, bits - 5)), "cell", "free").sortWithinPartitions("cell", "free", "fp")

    def stars(fp: np.ndarray, flips: np.ndarray, free: int):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for a, b in meetings(fp.view(np.uint64), flips, free, block):
            near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= radius
            for x, y in zip(fp[a][near].tolist(), fp[b][near].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        return list(parent), [root(x) for x in parent]

    def run(batches):
        wait, last = [], None  # the rows of one cell, which may reach over batches

        def flush():
            a, b = stars(*(np.concatenate(x) for x in zip(*wait, strict=True)), last[1])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            fp, flips, cell, free = (batch.column(c).to_numpy() for c in ("fp", "flips", "cell", "free"))
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(free) != 0)) + 1).tolist(), len(fp)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                own = (int(cell[i]), int(free[i]))
                if wait and own != last:
                    yield flush()
                    wait.clear()
                wait.append((fp[i:j].copy(), flips[i:j].copy()))
                last = own
        if wait:
            yield flush()

    return map_arrow(dealt, run, "a long, b long")


def classes(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry (doc_id among it), fp, root (a fingerprint that stands for the component) and component_id, one row per row of docs."""
    rows = written(fingerprints(docs, carry), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    roots = components(links(nodes.select("fp"), cell_bits(nodes.count())))
    rooted = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fp-roots")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "fp-least")
    found = written(rooted.join(least, "root").select("fp", "root", "component_id"), "fp-classes")
    return rows.join(found, "fp").select(*carry, "fp", "root", "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the least id of all that links reach), one row per row of docs.

    Null and empty texts have fingerprint zero and are linked like any others; a null doc_id
    has a row but is no component's least id unless all are null. Repeated rows have a row
    each, repeated ids of unlike texts the component of their own text. Very long texts are
    read whole. An empty table gives no rows; other columns are not read.
    """
    return classes(docs).drop("root")


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document; see groups() for null, empty and repeated rows."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies: the one of the least id, null ids last.

    Rows are told apart by id and text, so an id on unlike texts loses none of them but copies.
    Of several texts of the least id that are near copies one stays; of rows that repeat id and
    text the one whose columns have the least hash. A group without any id keeps one row.
    """
    keyed = docs.withColumn("_mw_key", row_key("doc_id", "text"))
    found = written(classes(keyed, ("doc_id", "_mw_key")).groupBy("root", "doc_id", "_mw_key").count(), "near-copies")
    # a key lies in one component, so membership needs no join by component, of which some are large
    best = written(found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_mw_key"))["_mw_key"].alias("_mw_key")).select("_mw_key", F.lit(True).alias("stays")), "best-copies")
    judged = written(found.join(best, "_mw_key", "left").select("doc_id", "_mw_key", F.coalesce("stays", F.lit(False)).alias("stays"), "count"), "judged-copies")
    # an id whose rows all go is dropped by the id, which is shorter than a key; rows of other ids, and of none, by their keys
    ids = written(judged.where("doc_id is not null").groupBy("doc_id").agg(F.every(~F.col("stays")).alias("all"), F.some(~F.col("stays")).alias("some")).where("some"), "touched-ids")
    whole = written(ids.where("all").select("doc_id"), "dropped-ids")
    part = judged.where("not stays").join(ids.where("all").select("doc_id"), "doc_id", "left_anti").select("_mw_key")
    part = written(part, "dropped-keys")
    twice = written(judged.where("stays and count > 1").select("_mw_key"), "repeated-copies")
    kept = keyed.join(whole, "doc_id", "left_anti").select(keyed.columns)
    if not part.isEmpty():
        kept = kept.join(part, "_mw_key", "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    own = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.join(twice, "_mw_key", "left_semi").groupBy("_mw_key").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("x")).select("x.*")
    return kept.join(twice, "_mw_key", "left_anti").select(docs.columns).unionByName(one)
