"""SimHash fingerprints and near-duplicate classes, candidates being pruned by the pigeonring principle.

A fingerprint has a bit for each of its places, set if it is set in over half of the hashes of the text's word shingles,
repeats included. Two fingerprints link if they differ in at most tau bits.

Pigeonring: cut a fingerprint into m segments that lie on a ring, with a budget of tau / m differences each. If two
fingerprints differ in at most tau bits, there is a segment from which every chain of l consecutive segments has at most
floor(l * tau / m) differences. A key is a chain's start: the first segment whole (its budget is below 1) and the second
with one bit left out, for every bit, which two fingerprints share just if they agree in the first and differ in at most
one bit of the second. Within a key the chain is followed round the ring, each step for those alone that kept to all
budgets before; the last step, the whole ring, is the full distance.

What is linked within a large key is a forest, not all pairs: a member that has joined a class is compared with those that
have not joined yet, so a large class of near copies costs about a comparison for each member, and equal fingerprints are
one member from the start. The classes are the connected components of the forests of all keys, with no cap on a key's
members, on candidates or on links.

Null and empty texts have the zero fingerprint and link like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import batches, may_hold, partitions, small_batches, table_of, unpacked, written

SEED = 42
#: Odd multipliers that turn a 64-bit hash into further ones come from this generator.
WORDS_SEED = 7919


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of so many words, joined by spaces; of all words if there are fewer."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    ends = starts[words:] + [len(whole) + 1]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(whole[a : b - 1], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def widened(hashes: np.ndarray, n: int) -> np.ndarray:
    """n 64-bit hashes for each: the first is the hash itself, the others are mixes of it."""
    if n == 1:
        return hashes[:, None]
    rng = np.random.default_rng(WORDS_SEED)
    factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = hashes[:, None] * factors
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x[:, 0] = hashes
    return x


def fingerprint(hashes: np.ndarray, n: int = 1) -> np.ndarray:
    """n words of 64 bits: a bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return np.zeros(n, dtype=np.uint64)
    ones = np.zeros(64 * n, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        block = widened(hashes[i : i + 4096], n).astype(">u8").view(np.uint8).reshape(-1, 8 * n)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def with_fingerprint(docs: DataFrame, words: int = 4, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the 64-bit fingerprint as a long (its bits, not its value)."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([int(fingerprint(shingle_hashes(t, words))[0].astype(np.int64)) for t in series], dtype="int64")

    return docs.withColumn(name, of(F.col(text)))


def segments(bits: int, m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments whose widths differ by one at most."""
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ring_keys(fp: Column, tau: int) -> Column:
    """The chain starts of a 64-bit fingerprint for m = tau + 1 segments: array of longs."""
    ring = segments(64, tau + 1)
    cut = lambda at: F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))
    keys = []
    for i, at in enumerate(ring):
        after = ring[(i + 1) % len(ring)]
        start = F.shiftleft(F.lit(i).cast("long"), 56).bitwiseOR(F.shiftleft(cut(at), 32))
        for bit in range(after[1]):
            left = F.lit((1 << after[1]) - 1 - (1 << bit)).cast("long")
            keys.append(start.bitwiseOR(F.shiftleft(F.lit(bit).cast("long"), 26)).bitwiseOR(cut(after).bitwiseAND(left)))
    return F.array(*keys)


def chained(seen: np.ndarray, start: np.ndarray, tau: int) -> np.ndarray:
    """The places of those differences (XORs of fingerprints) that keep to the budget of every chain from segment start on.

    Each step looks only at what all shorter chains have let through. The last chain is the whole ring, and its budget tau:
    what is left is within the full distance.
    """
    ring = segments(64, tau + 1)
    shifts, masks = (np.array(x, dtype=np.uint64) for x in zip(*((shift, (1 << width) - 1) for shift, width in ring)))
    left, total = np.arange(len(seen)), np.zeros(len(seen), dtype=np.int64)
    for step in range(len(ring)):
        at = (start[left] + step) % len(ring)
        total += np.bitwise_count((seen[left] >> shifts[at]) & masks[at])
        fits = total <= (step + 1) * tau // len(ring)
        left, total = left[fits], total[fits]
    return left


def forest(prints: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges (places) that connect just what near(one, others) connects: a forest of the group's classes."""
    out, left = [], np.arange(1, len(prints))
    front = [0]
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        at = front.pop()
        fits = near(prints[at], prints[left])
        if fits.any():
            joined = left[fits].tolist()
            out += [(at, j) for j in joined]
            front += joined
            left = left[~fits]
    return out


#: The rows of a key are compared with one another, all keys at once, up to so many; those of a larger key by a forest.
CROWD = 16


def whole_runs(parts: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The columns in pieces in which no run of equal keys (the first column, sorted) goes on in the next piece."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    for part in parts:
        if not part.num_rows:
            continue
        arrays = []
        for i in range(columns):
            column = part.column(i)
            whole = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)
            arrays.append(whole)
        keys = arrays[0]
        if held and held[-1][0][-1] != keys[0]:
            yield joined()
            held = []
        changes = np.flatnonzero(np.diff(keys))
        if not len(changes):
            held.append(arrays)
            continue
        last = int(changes[-1]) + 1
        held.append([x[:last] for x in arrays])
        yield joined()
        held = [[x[last:] for x in arrays]]
    if held:
        yield joined()


def small_pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (places) of equal keys, for runs of at most CROWD rows, by their distance."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    after = np.repeat(np.where(sizes <= CROWD, starts + sizes, 0), sizes) - np.arange(len(keys))
    for apart in range(1, CROWD):
        one = np.flatnonzero(after > apart)
        if not len(one):
            return
        yield one, one + apart


def large_runs(keys: np.ndarray) -> Iterator[slice]:
    """The places of the runs of more than CROWD rows."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    for at in np.flatnonzero(sizes > CROWD):
        yield slice(int(starts[at]), int(starts[at] + sizes[at]))


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(parts: Iterator[pa.RecordBatch], tau: int) -> Iterator[tuple]:
    """Edges of each key's group; rows come sorted by key, so a group ends where the key changes."""
    for keys, nodes, prints in whole_runs(parts, 3):
        prints, start = prints.view(np.uint64), keys >> 56

        def near(one: np.ndarray, others: np.ndarray, of: int) -> np.ndarray:
            fits = np.zeros(len(others), dtype=bool)
            fits[chained(one ^ others, np.full(len(others), of), tau)] = True
            return fits

        for one, other in small_pairs(keys):
            fits = chained(prints[one] ^ prints[other], start[one], tau)
            yield from zip(nodes[one[fits]].tolist(), nodes[other[fits]].tolist())
        for run in large_runs(keys):
            own = nodes[run]
            for i, j in forest(prints[run], lambda one, others, of=int(start[run.start]): near(one, others, of)):
                yield int(own[i]), int(own[j])


def near_edges(distinct: DataFrame, tau: int = 4) -> DataFrame:
    """Edges (a, b) between the nodes of distinct (node, fp), which must have each fp once.

    Edges connect two nodes just if links of at most tau differing bits do: within a key they are all links of a small
    group, and a forest of a larger one.
    """
    keyed = distinct.select(F.explode(ring_keys(F.col("fp"), tau)).alias("key"), "node", "fp")
    dealt = keyed.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda parts: batches(_linked(parts, tau), EDGES, most=65536), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, tau: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint has 16 hex digits; component_id is the least doc_id reachable over links of at most tau differing bits.
    A null doc_id takes part in its fingerprint's class but never names it unless there is no other.
    """
    small_batches(docs.sparkSession)
    prints = written(with_fingerprint(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.monotonically_increasing_id().alias("node"), "fp", "least"), "distinct")
    found = components(near_edges(distinct, tau))
    placed = distinct.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("class"))
    placed = written(placed, "placed")
    # a written table, so that the join of a large class can be split
    names = written(placed.groupBy("class").agg(F.min("least").alias("component_id")), "names")
    named = placed.join(names, "class").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Classes by similarity of shingle sets -----------------------------------------------------------------------------
#
# Two texts whose sets of shingles have Jaccard similarity s differ in a bit with a probability of about
# acos(2s / (1 + s)) / pi: 0.15 at 0.8. So a long fingerprint tells the similarity roughly (within 0.025 for 1,024 bits),
# but no segment of useful width need be equal. Fingerprints only name candidates: keys are the segments themselves, as
# many as make it likely (RECALL) that a pair at the threshold agrees in one and keeps to the ring's budgets in the chain
# after it. What is similar is settled on the sets themselves. Sets of few shingles, whose bits differ more often, are
# found by shared shingles instead (prefix filter), which misses none.

RECALL = 0.99
#: Bits of a segment: 16 or 32; wider ones give fewer accidental candidates and need many more segments.
WIDTH = 16
#: The budget of a ring is the distance of the threshold and so many standard deviations more.
SLACK = 4.0
#: Pairs with a set of at most so many shingles are found by shared shingles.
FEW = 40


def differing(similarity: float) -> float:
    """The probability that a bit differs between texts of this Jaccard similarity."""
    return float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)


def limit(similarity: float, bits: int) -> int:
    """The distance that the budgets of a ring of so many bits add up to."""
    p = differing(similarity)
    return int(bits * p + SLACK * (bits * p * (1 - p)) ** 0.5)


def chain_chance(similarity: float, width: int, budget: float) -> float:
    """The probability that the segments after an equal one keep to the budgets that chain_fits asks for."""
    p = differing(similarity)
    one = np.array([comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(width + 1)])
    total = np.ones(1)
    for step in range(64 // width):
        total = np.convolve(total, one)
        total[int((step + 2) * budget) + 1 :] = 0
    return float(total.sum())


def segments_for(similarity: float, width: int = WIDTH, recall: float = RECALL) -> int:
    """How many segments make it this likely that a pair at the threshold is a candidate; whole 64-bit words."""
    if width not in (16, 32):
        raise ValueError("segments have 16 or 32 bits")
    equal = (1 - differing(similarity)) ** width
    n = 64 // width
    while 1 - (1 - equal * chain_chance(similarity, width, limit(similarity, n * width) / n)) ** n < recall:
        n += 64 // width
    return n


def similar(shared, one, other, similarity: float):
    """Whether sets of these sizes that share so many have at least this Jaccard similarity (numbers, arrays or columns)."""
    return shared >= similarity * (one + other - shared) - 1e-9


def chain_fits(seen: np.ndarray, width: int, budget: float) -> np.ndarray:
    """The places where the following segments (from the high bits on) keep to the budget of every chain with the equal one before."""
    left, total = np.arange(len(seen)), np.zeros(len(seen), dtype=np.int64)
    for step in range(64 // width):
        total += np.bitwise_count((seen[left] >> np.uint64(64 - width * (step + 1))) & np.uint64((1 << width) - 1))
        fits = total <= int((step + 2) * budget)
        left, total = left[fits], total[fits]
    return left


def few_edges(few: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect just what pairs of similar sets do; few: node, few (a set of longs, FEW / similarity at most).

    Similar sets share one of their rarest n - ceil(similarity * n) + 1 shingles, in any order that is the same for all.
    The sets go along with these keys, so a key's group is a forest of exact comparisons.
    """
    most = int(FEW / similarity)
    each = few.select("node", F.explode("few").alias("s"))
    counted = each.join(each.groupBy("s").agg(F.count("*").alias("n")), "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("by"))
    size = F.size("by")
    rarest = counted.select("node", F.explode(F.slice("by", 1, (size - F.ceil(size * similarity - 1e-9) + 1).cast("int"))).alias("r"))
    padded = few.select("node", F.concat("few", F.array_repeat(F.lit(0).cast("long"), most - F.size("few"))).alias("few"))
    keyed = rarest.select(F.col("r.s").alias("key"), "node").join(padded, "node").select("key", "node", "few")
    keyed = keyed.repartition(partitions(few.sparkSession), "key").sortWithinPartitions("key")

    def near(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        shared = np.isin(others, one[one != 0]).sum(axis=1)
        return similar(shared, np.count_nonzero(one), np.count_nonzero(others, axis=1), similarity)

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for keys, nodes, sets in whole_runs(parts, 3):
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1:
                    for i, j in forest(sets[a:b], near):
                        yield int(nodes[a + i]), int(nodes[a + j])

    return keyed.mapInArrow(lambda parts: batches(linked(parts), EDGES, most=65536), "a long, b long").distinct()


def row_mark() -> Column:
    """A hash of doc_id and text; tells rows apart, a null doc_id from every other, but not a null text from an empty one."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit("")))


def _meeting(parts: Iterator[pa.RecordBatch], width: int, budget: float) -> Iterator[tuple]:
    """Of each key's rows (key, node, chain): an edge for each node that fits an earlier one, and every node that fits any, with itself."""
    near = _fits_all(width, budget)
    for keys, nodes, chains in whole_runs(parts, 3):
        chains, later = chains.view(np.uint64), np.zeros(len(keys), dtype=bool)
        linked = np.zeros(len(keys), dtype=bool)
        for one, other in small_pairs(keys):
            fits = chain_fits(chains[one] ^ chains[other], width, budget)
            one, other = one[fits], other[fits]
            later[one] = True
            fresh = ~linked[other]
            a, b = nodes[one[fresh]], nodes[other[fresh]]
            linked[other] = True
            yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())
        for run in large_runs(keys):
            for i, j in forest(chains[run], near):
                later[run.start + i] = later[run.start + j] = True
                yield tuple(sorted((int(nodes[run.start + i]), int(nodes[run.start + j]))))
        own = nodes[later | linked].tolist()
        yield from zip(own, own)


def _fits_all(width: int, budget: float):
    def near(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        fits = np.zeros(len(others), dtype=bool)
        fits[chain_fits(one ^ others, width, budget)] = True
        return fits

    return near


def _crossing(parts: Iterator[pa.RecordBatch], width: int, budget: float) -> Iterator[tuple]:
    """Pairs of clusters that fitting rows of a key (key, node, chain, cluster) connect; of large keys a forest's."""
    near = _fits_all(width, budget)
    for keys, _, chains, clusters in whole_runs(parts, 4):
        chains = chains.view(np.uint64)
        for one, other in small_pairs(keys):
            differ = clusters[one] != clusters[other]
            one, other = one[differ], other[differ]
            fits = chain_fits(chains[one] ^ chains[other], width, budget)
            a, b = clusters[one[fits]], clusters[other[fits]]
            yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())
        for run in large_runs(keys):
            own = clusters[run]
            if (own != own[0]).any():
                yield from {tuple(sorted((int(own[i]), int(own[j])))) for i, j in forest(chains[run], near) if own[i] != own[j]}


#: Shingles of the sets that a task compares at once; clusters of more are compared part by part.
SETS_AT_ONCE = 2_000_000


def similar_sets(sets: list[np.ndarray], parts: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Edges (places) that connect just what pairs of similar sets of different parts do; of one part, if there is one only.

    Sets in order of size meet in their rarest shingles (similar sets share one of the first n - ceil(similarity * n) + 1);
    what meets and isn't connected yet is compared in full.
    """
    alone = bool((parts == parts[0]).all())
    sizes = np.array([len(x) for x in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    split = np.split(ids, np.cumsum(sizes)[:-1])
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen: dict[int, list[int]] = {}
    for at in np.argsort(sizes, kind="stable").tolist():
        own = split[at]
        n = len(own)
        first = own[np.lexsort((own, counts[own]))][: n - int(np.ceil(similarity * n - 1e-9)) + 1].tolist()
        for other in sorted({x for i in first for x in seen.get(i, ())}):
            if (alone or parts[other] != parts[at]) and sizes[other] >= similarity * n - 1e-9 and top(other) != top(at):
                shared = len(np.intersect1d(own, split[other], assume_unique=True))
                if similar(shared, n, sizes[other], similarity):
                    root[top(other)] = top(at)
                    yield other, at
        for i in first:
            seen.setdefault(i, []).append(at)


def _settled(parts: Iterator[pa.RecordBatch], similarity: float) -> Iterator[tuple]:
    """Edges of the groups of rows (group, node, part, set), which come sorted by group."""
    held: list[tuple[int, int, np.ndarray]] = []
    last = None

    def ended() -> Iterator[tuple]:
        if len(held) > 1:
            for i, j in similar_sets([x[2] for x in held], np.array([x[1] for x in held]), similarity):
                yield tuple(sorted((held[i][0], held[j][0])))

    for batch in parts:
        groups, nodes, part = (batch.column(i).to_pylist() for i in range(3))
        lists = batch.column(3)
        edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, group in enumerate(groups):
            if group != last:
                yield from ended()
                held, last = [], group
            held.append((nodes[i], part[i], flat[edges[i] : edges[i + 1]].copy()))
    yield from ended()


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, first): the class of each row of docs, told by its first member.

    mark is row_mark(); first is struct<doc_id, mark> of the class's member of least doc_id (null last). Classes are
    connected components of pairs of similarity or more, as their sets of shingles tell it. A pair at the threshold is a
    candidate with about RECALL, one above it more surely, and one with a set of FEW shingles or less always.

    Two passes over the keys gather what is connected by candidates in clusters, without naming all candidates: the first
    links each set with one that it meets, the second links the clusters that still meet. Within a cluster all sets are
    compared that may be similar, exactly and as far as they aren't connected yet. A cluster of more than SETS_AT_ONCE
    shingles is cut in parts, and each pair of parts is a group of its own.
    """
    n_segments = segments_for(similarity, width)
    n_words = n_segments * width // 64
    budget = limit(similarity, 64 * n_words) / n_segments
    most = int(FEW / similarity)
    spark = docs.sparkSession
    small_batches(spark)

    @F.pandas_udf("fp array<long>, digest binary, few array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            sets = [np.unique(shingle_hashes(t, words)) for t in series]
            fps = [fingerprint(x, n_words).astype(np.int64) for x in sets]
            few = [x.astype(np.int64) if len(x) <= most else None for x in sets]
            yield pd.DataFrame({"fp": fps, "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "few": few})

    @F.pandas_udf("array<long>")
    def set_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([np.unique(shingle_hashes(t, words)).astype(np.int64) for t in series])

    prints = written(docs.select("doc_id", row_mark().alias("mark"), of(F.col("text")).alias("p")).select("doc_id", "mark", "p.*"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))).alias("least")
    by_set = prints.groupBy("digest").agg(first, F.first("fp").alias("fp"), F.first("few").alias("few"))
    distinct = written(by_set.select(F.monotonically_increasing_id().alias("node"), "digest", "fp", "few", "least"), "distinct")

    per_word = 64 // width

    def word(i: int) -> Column:
        return F.element_at("fp", i % n_words + 1)

    def segment(i: int) -> Column:
        return F.shiftrightunsigned(word(i // per_word), 64 - width * (i % per_word + 1)).bitwiseAND(F.lit((1 << width) - 1))

    def following(i: int) -> Column:
        """The 64 bits after segment i on the ring."""
        shift = width * ((i + 1) % per_word)
        at = (i + 1) // per_word
        return F.shiftleft(word(at), shift).bitwiseOR(F.shiftrightunsigned(word(at + 1), 64 - shift)) if shift else word(at)

    seeds = F.array(*(F.struct(F.shiftleft(F.lit(i).cast("long"), width).bitwiseOR(segment(i)).alias("key"), following(i).alias("chain")) for i in range(n_segments)))

    def keyed(nodes: DataFrame, *more: str) -> DataFrame:
        """A row for each segment of nodes (node, fp, more), dealt and sorted by key."""
        rows = nodes.select("node", *more, F.explode(seeds).alias("s")).select("s.key", "node", "s.chain", *more)
        return rows.repartition(partitions(spark), "key").sortWithinPartitions("key")

    as_edges = lambda f: lambda parts: batches(f(parts, width, budget), EDGES, most=65536)
    met = keyed(distinct).mapInArrow(as_edges(_meeting), "a long, b long").groupBy("b").agg(F.min("a").alias("a"))
    met = written(met.select("a", "b"), "met")

    members = written(distinct.join(met.select(F.col("b").alias("node")), "node").select("node", "least.mark"), "members")
    # only texts whose sets are compared are moved
    table = table_of(members.select(F.col("mark").alias("hash")))
    texts = docs.select(row_mark().alias("mark"), "text").where(may_hold(spark, table, F.col("mark")))
    sets = texts.join(members, "mark").select("node", set_of(F.col("text")).alias("set"))
    # rows that agree in doc_id and text have the same node
    sets = written(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")

    linked = components(met.where("a <> b"))
    own = distinct.join(members.select("node"), "node").join(linked, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("cluster"))
    own = written(own, "clusters")
    crossing = keyed(own, "cluster").mapInArrow(as_edges(_crossing), "a long, b long")
    joined = components(crossing).toDF("cluster", "whole")
    whole = own.join(joined, "cluster", "left").select("node", F.coalesce("whole", "cluster").alias("cluster"))
    sets = written(sets.join(whole, "node").select("node", "cluster", "set"), "clustered")
    sizes = sets.groupBy("cluster").agg(F.sum(F.size("set")).alias("shingles"), F.count("*").alias("n")).where("n > 1")
    # a written table, so that the join of a large cluster can be split
    sizes = written(sizes.select("cluster", F.ceil(F.col("shingles") / SETS_AT_ONCE).cast("int").alias("parts")), "sizes")
    part = F.pmod(F.hash("node"), F.col("parts"))
    rows = sets.join(sizes, "cluster").select("cluster", "node", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "set")
    group = F.xxhash64("cluster", F.least("part", "other"), F.greatest("part", "other"))
    dealt = rows.select(group.alias("group"), "node", "part", "set").repartition(partitions(spark), "group").sortWithinPartitions("group")
    edges = dealt.mapInArrow(lambda parts: batches(_settled(parts, similarity), EDGES, most=65536), "a long, b long")

    few = few_edges(distinct.where(F.size("few") > 0).select("node", "few"), similarity)
    found = components(written(edges.unionByName(few), "edges"))
    placed = written(distinct.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("class")), "placed")
    # a written table, so that the join of a large class can be split
    names = written(placed.groupBy("class").agg(F.min("least").alias("least")), "names")
    named = placed.select("digest", "class").join(names, "class").select("digest", F.struct("least.doc_id", "least.mark").alias("first"))
    return prints.select("doc_id", "mark", "digest").join(named, "digest").select("doc_id", "mark", "first")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The first document of each class of similar ones, with the columns of docs.

    Of rows that agree in doc_id and text one stays, the least by its other columns as JSON. Rows alone in their class stay
    where they are; only the rows of larger classes are moved to be told apart.
    """
    classes = written(similar_classes(docs.select("doc_id", "text"), words, similarity).select("mark", F.col("first.mark").alias("first")), "classes")
    # a written table, so that the join of a large class can be split
    several = written(classes.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first"), "several")
    members = written(classes.join(several, "first").select("mark", (F.col("mark") == F.col("first")).alias("is_first")).distinct(), "members")
    table = table_of(members.select(F.col("mark").alias("hash")))
    rows = docs.select(F.struct("*").alias("row"), row_mark().alias("mark"))
    may = may_hold(docs.sparkSession, table, F.col("mark"))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    by = Window.partitionBy("mark").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    moved = rows.where(may).join(members, "mark", "left").where("is_first is null or is_first")
    kept = moved.withColumn("place", F.row_number().over(by)).where("place = 1")
    return unpacked(rows.where(~may).select("row").unionByName(kept.select("row")))
