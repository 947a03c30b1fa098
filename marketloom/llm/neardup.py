"""Near duplicates by MinHash: banded signatures propose, signatures and full sets confirm, stars join."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ASCII_LOWER, SEPARATORS, discard, materialise, small_batches, worker_cache
from marketloom.llm.components import connected_components
from marketloom.llm.lines import TEXT_KEY

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed at once.
_BLOCK = 1 << 22


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes (A-Z as a-z), which bytes separate words, and powers of an odd number with their inverses."""
    cache = worker_cache("bytes")
    if "letters" not in cache:
        letters = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for upper, lower in ASCII_LOWER.items():
            letters[upper] = letters[lower]
        gaps = np.zeros(256, dtype=bool)
        gaps[list(SEPARATORS.encode())] = True
        cache["letters"], cache["gaps"], cache["size"] = letters, gaps, 0
    if cache["size"] < n:
        size = max(1 << 14, 1 << n.bit_length())
        steps = np.full(size, _ODD[0], dtype=np.uint64)
        back = np.full(size, np.uint64(pow(int(_ODD[0]), -1, 1 << 64)), dtype=np.uint64)
        steps[0] = back[0] = np.uint64(1)
        cache["powers"], cache["inverse"], cache["size"] = np.multiply.accumulate(steps), np.multiply.accumulate(back), size
    return cache["letters"], cache["gaps"], cache["powers"], cache["inverse"]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z as a-z, in order.

    A word's hash is the difference of two running sums of its bytes' random numbers times powers, moved to a common start and
    mixed with its length, so the whole text is hashed with a few vector operations.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(hashes_of_bytes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def hashes_of_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some bytes, and where they start."""
    part = np.frombuffer(raw, dtype=np.uint8)
    letters, gaps, powers, inverse = _tables(len(part) + 1)
    inside = np.concatenate([[False], ~gaps[part], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(letters[part] * powers[: len(part)], dtype=np.uint64)])
    return _mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * _ODD[1]), first


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of all shingles of `size` words in order; the whole sequence as one where it has fewer words.

    Two different shingles of a corpus share a hash once in about 2 ** 64 pairs.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = _mixed(out * _ODD[i % 5] + h[i : len(h) - n + 1 + i])
    return out


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache("multipliers")
    if k not in cache:
        r = np.random.default_rng(20240)
        cache[k] = (r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, k, dtype=np.uint64))
    return cache[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k minima of universal (multiply-shift) hashes, 32 bits each."""
    a, b = _multipliers(k)
    best = np.full(k, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at : at + 512]
        h = x[:, None] * a[None, :]
        h += b[None, :]
        best = np.minimum(best, h.min(axis=0) >> np.uint64(32))
    return best.astype(np.uint32)


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows such that a pair at the threshold shares a band with a probability of about 0.99999."""
    return (24, 6) if threshold >= 0.85 else (28, 5) if threshold >= 0.8 else (32, 4)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, TEXT_KEY, n_shingles, s1 and s2 (128 bits of the set), sig (binary), keys (one long a band), of every text."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text_key, t in zip(pdf["doc_id"], pdf[TEXT_KEY], pdf["text"]):
                s = np.unique(shingle_hashes(None if t is None or t != t else t, size))
                if not len(s):
                    out.append((doc_id, text_key, 0, 0, 0, b"", []))
                    continue
                sig = signature(s, bands * rows)
                key = np.zeros(bands, dtype=np.uint64)
                for r in range(rows):
                    key = _mixed(key * _ODD[0] + sig.reshape(bands, rows)[:, r])
                key = _mixed(key + np.arange(bands, dtype=np.uint64) * _ODD[1]).view(np.int64)
                one, two = s.sum(), _mixed(s * _ODD[2] + _ODD[3]).sum()
                out.append((doc_id, text_key, len(s), int(one.view(np.int64)), int(two.view(np.int64)), sig.tobytes(), key))
            yield pd.DataFrame(out, columns=["doc_id", TEXT_KEY, "n_shingles", "s1", "s2", "sig", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias(TEXT_KEY), "text").mapInPandas(sketch, f"doc_id long, {TEXT_KEY} long, n_shingles long, s1 long, s2 long, sig binary, keys array<long>")


def _alike(pairs: DataFrame, sigs: DataFrame, threshold: float, k: int) -> DataFrame:
    """Signature verification: drop pairs whose sizes or whose share of equal minima rule the threshold out (four deviations)."""
    least = threshold - 4 * sqrt(threshold * (1 - threshold) / k)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)) >= least for x, y in zip(a, b)], dtype=bool)

    left, right = (sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9).filter(near("sig_a", "sig_b")).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""
    texts = docs.select("doc_id", "text")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict = {}
        for pdf in batches:
            held = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                if a not in sets:
                    if len(sets) >= 64:
                        sets.clear()
                    sets[a] = np.unique(shingle_hashes(ta, size))
                x, y = sets[a], np.unique(shingle_hashes(tb, size))
                common = len(x) + len(y) - len(np.union1d(x, y))
                held.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[held, ["a", "b"]]

    return both.mapInPandas(confirm, "a long, b long")


def _can_link(open_docs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_ids of open_docs (doc_id, component) that may link across components, by the prefix filter.

    Put each set's shingles in order of how few of the open documents hold them. Two sets as similar as the threshold must
    share one of the first n - ceil(threshold * n) + 1, so a document whose rarest shingles nobody else's component holds has
    no open link. The filter loses nothing.
    """
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in some["text"]]
                n = [len(s) for s in sets]
                if sum(n):
                    yield pd.DataFrame({"doc_id": np.repeat(some["doc_id"].to_numpy(), n), "component": np.repeat(some["component"].to_numpy(), n), "n": np.repeat(n, n), "h": np.concatenate(sets)})

    each = materialise(open_docs.join(texts, "doc_id").select("doc_id", "component", "text").mapInPandas(shingles, "doc_id long, component long, n long, h long"), "open_shingles")
    held = each.groupBy("h").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("crosses"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "h"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    able = materialise(each.join(held, "h").withColumn("_place", order).filter((F.col("_place") <= prefix) & F.col("crosses")).select("doc_id").distinct(), "able")
    discard(each)
    return able


#: Documents of a block in which open links are looked for.
_BLOCK_DOCS = 256


def _open_links(open_: DataFrame, texts: DataFrame, size: int, percent: int, k: int) -> DataFrame:
    """Links across components among the members of open buckets (key, doc_id, component), block against block.

    Documents that share buckets, directly or over others, form a cluster. A cluster's documents are dealt by hash to blocks of
    about _BLOCK_DOCS, and each task compares two blocks on signatures and full sets and returns the links alone: no pair
    becomes a row, and no task holds more than two blocks, whatever the cluster's size.
    """
    threshold = percent / 100
    least = threshold - 4 * sqrt(threshold * (1 - threshold) / k)
    first = open_.groupBy("key").agg(F.min("doc_id").alias("u"))
    named = connected_components(open_.join(first, "key").select("u", F.col("doc_id").alias("v")))
    clusters = named.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / _BLOCK_DOCS).cast("int").alias("blocks"))
    rows = clusters.join(blocks, "cluster").join(open_.select("doc_id", "component").distinct(), "doc_id").join(texts, "doc_id")

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "component", "cluster", "blocks"]].assign(set=[np.unique(shingle_hashes(t, size)).tobytes() for t in pdf["text"]])

    sets = rows.select("doc_id", "component", "cluster", "blocks", "text").mapInPandas(with_sets, "doc_id long, component long, cluster long, blocks int, set binary")
    sets = materialise(sets.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "open_sets")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        ids, parts, block = p["doc_id"].to_numpy(), p["component"].to_numpy(), p["block"].to_numpy()
        own = [np.frombuffer(x, dtype=np.uint64) for x in p["set"]]
        n, sigs = np.array([len(x) for x in own]), np.stack([signature(x, k) for x in own])
        one_block, out = block.min() == block.max(), []
        for i in range(len(ids)):
            ok = (parts != parts[i]) & (ids > ids[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9)
            if not one_block:
                ok &= block != block[i]
            at = np.flatnonzero(ok)
            at = at[(sigs[at] == sigs[i]).mean(axis=1) >= least] if len(at) else at
            for j in at:
                common = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if 100 * common >= percent * (n[i] + n[j] - common):
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = dealt.select("doc_id", "component", "cluster", "block", "lo", "hi", "set").groupBy("cluster", "lo", "hi").applyInPandas(compare, "a long, b long")
    found = materialise(found, "links")
    for spent in (named, sets):
        discard(spent)
    return found


def near_duplicate_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """near_duplicates with TEXT_KEY, which with doc_id finds the row again."""
    small_batches(docs.sparkSession)
    bands, rows = banding(percent / 100)
    base = materialise(sketches(docs.filter("doc_id is not null"), size, bands, rows), "sketches")
    sets = base.filter("n_shingles > 0")
    heads = sets.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", TEXT_KEY)).alias("h")).select("s1", "s2", F.col("h.doc_id").alias("doc_id"), F.col(f"h.{TEXT_KEY}").alias(TEXT_KEY))
    # A set is known by a number of its own, doc_id below, since a doc_id may come with several texts.
    reps = sets.join(heads, ["s1", "s2", "doc_id", TEXT_KEY], "left_semi").dropDuplicates(["s1", "s2"])
    reps = materialise(reps.withColumnRenamed("doc_id", "head").withColumn("doc_id", F.monotonically_increasing_id()), "representatives")
    # Only representatives need signatures and keys from here on.
    full, base = base, materialise(base.select("doc_id", TEXT_KEY, "n_shingles", "s1", "s2"), "sets")
    discard(full)
    sets = base.filter("n_shingles > 0")
    sigs = reps.select("doc_id", "sig", "n_shingles")
    own = docs.select(F.col("doc_id").alias("head"), F.xxhash64("text").alias(TEXT_KEY), "text").join(reps.select("head", TEXT_KEY, "doc_id"), ["head", TEXT_KEY])
    # Written, so that whole texts are not shuffled again for each round that confirms.
    texts = materialise(own.select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
    members = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = materialise(members.join(shared, "key"), "buckets")

    links = tried = components = None

    def joined(found: DataFrame) -> None:
        """Components with the links found; without a new one they stay."""
        nonlocal links, components
        if components is not None and not found.take(1):
            return discard(found)
        links = found if links is None else links.unionByName(found)
        old, components = components, connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if old is not None:
            discard(old)

    def verify(pairs: DataFrame) -> None:
        nonlocal tried
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        alike = materialise(_alike(pairs, sigs, percent / 100, bands * rows), "alike")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialise(_confirmed(alike, texts, size, percent), "links")
        discard(alike)
        joined(found)

    verify(members.filter("a < doc_id").select("a", F.col("doc_id").alias("b")))
    for turn in (1, 2, 3):
        named = members.select("key", "doc_id").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.min_by(F.struct("doc_id", "component"), F.xxhash64("doc_id", F.lit(turn))).alias("leader")).filter("lo < hi")
        open_ = named.join(mixed.select("key", "leader"), "key")
        if turn < 3:
            verify(open_.filter(F.col("component") != F.col("leader.component")).select(F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b")))
            continue
        open_ = materialise(open_.select("key", "doc_id", "component"), "open")
        able = _can_link(open_.select("doc_id", "component").distinct(), texts, size, percent / 100)
        rest = materialise(open_.join(able, "doc_id", "left_semi"), "open")
        for spent in (open_, able, tried, members):
            discard(spent)
        joined(_open_links(rest, texts, size, percent, bands * rows))
        discard(rest)

    part_of = reps.select("s1", "s2", "head", "doc_id").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    least = part_of.groupBy("component").agg(F.min("head").alias("component_id"))
    named = materialise(part_of.select("s1", "s2", "component").join(least, "component").select("s1", "s2", "component_id"), "named_sets")
    shown = ["doc_id", TEXT_KEY, "n_shingles", "component_id"]
    for spent in (links, components, texts, reps):
        discard(spent)
    out = sets.select("doc_id", TEXT_KEY, "n_shingles", "s1", "s2").join(named, ["s1", "s2"]).select(shown)
    alone = base.filter("n_shingles = 0").select("doc_id", TEXT_KEY, "n_shingles", F.col("doc_id").alias("component_id"))
    out = materialise(out.unionByName(alone), "near_duplicates")
    for spent in (base, named):
        discard(spent)
    nulls = docs.filter("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias(TEXT_KEY), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nulls).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    1. Equal sets fall together by 128 bits of the set, so copies cost one representative however many there are.
    2. Every band bucket proposes links to its least member only (as many pairs as members). Signatures discard, full sets
       confirm, stars give components.
    3. Buckets that still hold several components propose again with other leaders, only across components; members of one
       component need no more links. In buckets that stay split, the prefix filter first drops the documents that cannot link
       anywhere else; what is left is compared block by block, across components only, so that no link that the bands
       propose is missed and no pair without a link becomes a row.

    Returns doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id), one row for each row
    given. Texts without words and nulls have no shingles and link with nothing. Rows that repeat a doc_id count by their own
    texts: each has the component of its text. A null doc_id is its own component (null) and kept. An empty table gives no
    rows; other columns are not looked at.
    """
    return near_duplicate_rows(docs, size, percent).drop(TEXT_KEY)
