"""Near duplicates by SimHash: fingerprints in Gray order under shared masked bit patterns, searched as a hierarchy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise, small_batches
from marketloom.llm.components import connected_components

#: Bytes of a text that are split into words at once; fingerprints of a block; members of a node of the hierarchy.
_PIECE, _BLOCK, _FAN = 1 << 22, 1024, 8

_SPACES = b" \t\n\x0b\x0c\r"
_ONE = np.uint64(1)


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some MB at a time. bytes.lower and bytes.split know only ASCII: A-Z, and exactly the six separators."""
    at = 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end].lower().split()
        at = end


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """64 bits, each set where over half of the XXH64 of the shingles (repeats included) have it; 0 without words."""
    ones, n, kept, digest = np.zeros(64, dtype=np.int64), 0, [], xxhash.xxh64_intdigest
    if not text:
        return 0
    for words in _pieces(text.encode("utf-8", "surrogatepass")):
        words = kept + words
        if len(words) >= size:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            line = b" ".join(words)
            h = np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype="<u8")
            for i in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n, words = n + len(h), words[len(words) - size + 1 :]
        kept = words
    if not n:
        return digest(b" ".join(kept), seed) if kept else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> _ONE)


class Masks:
    """The bit patterns of the uppermost nodes.

    64 bits are cut into near + 2 parts; fingerprints at `near` or fewer differing bits agree in two parts at least. For every two
    parts a table holds each fingerprint with these parts moved to the front, so equal front bits make an uppermost node, whose
    members follow each other in Gray order. A pair that is near is together in at least one node of one table.
    """

    def __init__(self, near: int):
        cuts = np.linspace(0, 64, near + 3).round().astype(int)
        parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        self.orders, self.fronts = [], []
        for pair in combinations(range(len(parts)), 2):
            # Parts in their new order, as (first bit, bits), highest first.
            self.orders.append([(parts[i][0], parts[i][1] - parts[i][0]) for i in (*pair, *(j for j in range(len(parts)) if j not in pair))])
            self.fronts.append(sum(n for _, n in self.orders[-1][:2]))

    def front(self, fingerprints: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros_like(fingerprints)
        for first, n in self.orders[table]:
            out = (out << np.uint64(n)) | ((fingerprints >> np.uint64(first)) & np.uint64((1 << n) - 1))
        return out

    def back(self, moved: np.ndarray, table: int) -> np.ndarray:
        out, shift = np.zeros_like(moved), 64
        for first, n in self.orders[table]:
            shift -= n
            out |= ((moved >> np.uint64(shift)) & np.uint64((1 << n) - 1)) << np.uint64(first)
        return out


def _shared(lows: np.ndarray, highs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that begin at starts: the bits set in all members, and those set in any."""
    return np.bitwise_and.reduceat(lows, starts), np.bitwise_or.reduceat(highs, starts)


def near_pairs(x: np.ndarray, node: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of one node whose bit patterns differ in `near` bits or fewer. x is in Gray order inside each node.

    Runs of _FAN neighbours inside a node make the lowest groups, runs of groups the next ones, until every node is one group. A group
    keeps the pattern of the bits that its members share, less those that the group above it already holds. Every pattern goes
    down from its node: what differs in a group's own bits adds to what differed above, and a group whose sum exceeds `near`, or
    whose members all come before the pattern, is left with all that hangs below it.
    """
    levels = [(x, x, np.arange(len(x)), np.arange(1, len(x) + 1), node)]  # bits of all, of any, first member, end, node
    while len(levels[-1][0]) > len(np.unique(levels[-1][4])):
        low, high, first, end, of = levels[-1]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        inside = np.arange(len(of)) - np.repeat(at, np.diff(np.append(at, len(of))))
        starts = np.flatnonzero(inside % _FAN == 0)
        ends = np.append(starts[1:], len(of))
        levels.append((*_shared(low, high, starts), first[starts], end[ends - 1], of[starts]))
    # Every pattern asks from the group of its node downwards.
    top = levels[-1]
    asks = np.arange(len(x))
    group = np.searchsorted(top[4], node)
    apart = np.zeros(len(x), dtype=np.int64)
    held = np.zeros(len(top[0]), dtype=np.uint64)  # bits that the groups above hold, for each group of the level
    for depth in range(len(levels) - 1, -1, -1):
        low, high, _, end, _ = levels[depth]
        agree = ~(low ^ high)
        own = agree & ~held
        apart = apart + np.bitwise_count((x[asks] ^ low[group]) & own[group])
        keep = (apart <= near) & (end[group] > asks + 1)
        asks, group, apart = asks[keep], group[keep], apart[keep]
        if not depth:
            break
        begin = levels[depth][2]
        below = levels[depth - 1]
        child = np.searchsorted(below[2], begin)
        n_children = np.append(child[1:], len(below[2])) - child
        held = np.repeat(agree, n_children)
        many = n_children[group]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        asks, apart, group = np.repeat(asks, many), np.repeat(apart, many), np.repeat(child[group], many) + offset
    later = group > asks
    return asks[later], group[later]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each of n members reaches over the pairs."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


_TURN = _ONE << np.uint64(63)
_ROWS = "u long, v long, t int, key long, agree long, shared long, lo long, members binary"


def _forest(x: np.ndarray, node: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (member, least member that it reaches) of what is near inside each node, where they are not the same."""
    i, j = near_pairs(x, node, near)
    label = spanning(len(x), i, j)
    moved = np.flatnonzero(label != np.arange(len(x)))
    return moved, label[moved]


def _forests(x: np.ndarray, block: np.ndarray, near: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_forest of so many whole blocks at once that their possible pairs are about `most`."""
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(x))
    sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
    turn = (np.cumsum(sizes ** 2) - 1) // most
    lo = 0
    for hi in [*ends[np.flatnonzero(turn[1:] != turn[:-1])].tolist(), len(x)]:
        i, j = _forest(x[lo:hi], block[lo:hi], near)
        yield i + lo, j + lo
        lo = hi


class _Blocks:
    """Takes a task's sorted rows in turn; gives links, and the blocks of nodes that have more blocks here or in another task."""

    def __init__(self, masks: Masks, near: int, size: int):
        self.masks, self.near, self.size = masks, near, size
        self.t, self.x = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.uint64)
        self.shifts = np.array([64 - f for f in masks.fronts], dtype=np.uint64)
        self.before = None  # the node of the block before; None at the start, whose node may have begun in another task

    def add(self, t: np.ndarray, x: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        self.t, self.x = np.concatenate([self.t, t]), np.concatenate([self.x, x])
        if not len(self.x):
            return
        key = self.x >> self.shifts[self.t]
        begins = np.concatenate([[True], (self.t[1:] != self.t[:-1]) | (key[1:] != key[:-1])])
        first = np.flatnonzero(begins)
        place = np.arange(len(self.x)) - np.repeat(first, np.diff(np.append(first, len(self.x))))
        cuts = np.flatnonzero(place % self.size == 0)
        stop = len(self.x) if last else int(cuts[-1])  # the last block may go on
        done = cuts[cuts < stop]
        if len(done):
            yield from self._search(self.t[:stop], self.x[:stop], key, done, stop, last)
        self.t, self.x = self.t[stop:], self.x[stop:]

    def _search(self, t: np.ndarray, x: np.ndarray, key: np.ndarray, cuts: np.ndarray, stop: int, last: bool) -> Iterator[pa.RecordBatch]:
        ends = np.append(cuts[1:], stop)
        block = np.repeat(np.arange(len(cuts)), ends - cuts)
        nodes = [(int(a), int(b)) for a, b in zip(t[cuts], key[cuts])]
        after = None if last else (int(self.t[stop]), int(key[stop]))
        goes_on = np.array([a == b for a, b in zip(nodes, [*nodes[1:], after])])
        goes_on[-1] |= last
        came = np.array([a == b for a, b in zip(nodes, [self.before, *nodes[:-1]])])
        came[0] |= self.before is None
        self.before = nodes[-1]
        fp = np.empty_like(x)
        for one in np.unique(t):
            fp[t == one] = self.masks.back(x[t == one], int(one))
        several = (ends - cuts > 1)[block]
        at = np.flatnonzero(several)
        for i, j in _forests(x[at], block[at], self.near, _BLOCK ** 2) if len(at) else ():
            yield self._rows(u=fp[at[i]].view(np.int64), v=fp[at[j]].view(np.int64))
        open_ = np.flatnonzero(goes_on | came)
        if len(open_):
            any_, all_ = np.bitwise_or.reduceat(x, cuts)[open_], np.bitwise_and.reduceat(x, cuts)[open_]
            members = [x[cuts[b] : ends[b]].tobytes() for b in open_]
            yield self._rows(t=t[cuts[open_]], key=key[cuts[open_]].view(np.int64), agree=(~(any_ ^ all_)).view(np.int64), shared=all_.view(np.int64),
                             lo=x[cuts[open_]].view(np.int64), members=pa.array(members, type=pa.binary()))

    @staticmethod
    def _rows(**columns: object) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"t": pa.int32(), "members": pa.binary()}
        names = ["u", "v", "t", "key", "agree", "shared", "lo", "members"]
        return pa.RecordBatch.from_arrays([pa.array(columns[c], type=kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)


def fingerprint_links(marks: DataFrame, near: int = 4, size: int = _BLOCK) -> DataFrame:
    """Links (u, v) of distinct fingerprints (fp): a forest of all pairs that differ in `near` bits or fewer.

    1. Every fingerprint goes to the tables of Masks as its Gray rank; a range exchange sorts each table, whatever a node's size.
    2. A task cuts what it holds into blocks of at most `size` neighbours inside one node, finds the near pairs of each block and
       returns a forest of them; blocks of nodes that go on in another block are returned with their members.
    3. Blocks of such a node meet in pairs, unless the bits that each shares differ in more than `near` places, or both are wholly
       in one component already, as the blocks of a large group of copies are. No pair of fingerprints is a row.
    """
    masks = Masks(near)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t in range(len(masks.orders)):
                # The highest bit turned, so that signed order is that of the ranks.
                yield pa.RecordBatch.from_pydict({"t": np.full(len(fp), t, dtype=np.int32), "rank": (gray_rank(masks.front(fp, t)) ^ _TURN).view(np.int64)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(masks, near, size)
        for batch in batches:
            yield from blocks.add(batch.column(0).to_numpy(), gray_code(batch.column(1).to_numpy().view(np.uint64) ^ _TURN), False)
        yield from blocks.add(blocks.t[:0], blocks.x[:0], True)

    moved = materialise(marks.select("fp").mapInArrow(ranks, "t int, rank long"), "gray_ranks")
    found = materialise(moved.repartitionByRange("t", "rank").sortWithinPartitions("t", "rank").mapInArrow(search, _ROWS), "gray_blocks")
    links = found.filter("u is not null").select("u", "v").distinct()
    node = ["t", "key"]
    blocks = found.filter("members is not null").drop("u", "v")
    several = blocks.groupBy(*node).agg(F.count("*").alias("n")).filter("n > 1").select(*node)
    blocks = materialise(blocks.join(several, node, "left_semi"), "open_blocks")
    if not blocks.take(1):
        return links

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, lo, raw in zip(*(c.to_pylist() for c in batch.columns)):
                fp = masks.back(np.frombuffer(raw, dtype=np.uint64), t).view(np.int64)
                yield pa.RecordBatch.from_pydict({"t": np.full(len(fp), t, dtype=np.int32), "lo": np.full(len(fp), lo), "fp": fp})

    links = materialise(links, "links")
    parts = connected_components(links).select(F.col("node").alias("fp"), "component")
    own = blocks.select("t", "lo", "members").mapInArrow(members, "t int, lo long, fp long").join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    own = own.groupBy("t", "lo").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    heads = materialise(blocks.drop("members").join(own, ["t", "lo"]), "block_heads")
    a, b = (heads.select(*node, *[F.col(c).alias(f"{c}_{side}") for c in ("lo", "agree", "shared", "c0", "c1")]) for side in "ab")
    apart = F.bit_count(F.col("shared_a").bitwiseXOR(F.col("shared_b")).bitwiseAND(F.col("agree_a")).bitwiseAND(F.col("agree_b")))
    one = (F.col("c0_a") == F.col("c1_a")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0_a") == F.col("c0_b"))
    pairs = a.join(b, node).filter((F.col("lo_a") < F.col("lo_b")) & (apart <= near) & ~one).select("t", "lo_a", "lo_b")
    for side in "ab":
        pairs = pairs.join(blocks.select("t", F.col("lo").alias(f"lo_{side}"), F.col("members").alias(f"members_{side}")), ["t", f"lo_{side}"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(left + right, dtype=np.uint64)
                i, j = _forest(x, np.zeros(len(x), dtype=np.int64), near)
                fp = masks.back(x, t).view(np.int64)
                yield pa.RecordBatch.from_pydict({"u": fp[i], "v": fp[j]})

    met = pairs.select("t", "members_a", "members_b").mapInArrow(meet, "u long, v long")
    return links.unionByName(materialise(met, "links"))


def simhash_duplicates(docs: DataFrame, size: int = 4, near: int = 4, seed: int = 42) -> DataFrame:
    """Components of documents whose fingerprints of `size`-word shingles differ in `near` bits or fewer.

    Words are what stands between the six ASCII separators, A-Z as a-z. Equal fingerprints fall together first, so copies cost
    one however many there are; fingerprint_links joins the others and stars give components.

    Returns doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component), one row for each row given. Fewer
    words than `size` are one shingle; null, empty and blank texts have fingerprint zero, which links like any other. Rows that
    repeat a doc_id count by their own texts. A null doc_id names no component: its row carries the least other doc_id of its
    component, or null. An empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def mark(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(None if t is None or t != t else t, size, seed) for t in text], dtype=np.uint64).view(np.int64))

    base = materialise(docs.select("doc_id", mark("text").alias("fp")), "fingerprints")
    marks = materialise(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    parts = connected_components(fingerprint_links(marks, near)).select(F.col("node").alias("fp"), "component")
    named = marks.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "named")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return base.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
