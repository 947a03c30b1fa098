"""Near-duplicate passages by compact windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import discard, materialise, small_batches
from marketloom.llm.lines import TEXT_KEY
from marketloom.llm.neardup import _ODD, _mixed, hashes_of_bytes, shingle_hashes

#: Words of the shortest passage, words of a shingle, hash functions, how many must agree, similarity in percent.
MIN_WORDS, SHINGLE, HASHES, AGREE, PERCENT = 50, 5, 4, 2, 80
#: Shared shingles in a row that every passage has; shingles on each side of an anchor that its key covers.
RUN, REACH = 20, 5
#: Least of the positions around an anchor of a passage whose shingle lies around its partner too: see _may_hold.
ENOUGH = 33
#: Anchors of a block that is compared with others of its key; shingles of two blocks that are compared at once.
_BLOCK_ANCHORS, _BLOCK_COLUMNS = 512, 4096
#: Bytes of the texts that are hashed together.
_TOGETHER = 1 << 17


def shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes of each text in one array, and how many each has; texts of under SHINGLE words have none.

    Short texts are hashed together: most of the time of hashing them one by one goes into the calls.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    out, n, at = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0
    while at < len(raws):
        if len(raws[at]) >= _TOGETHER:
            h = shingle_hashes(texts[at], SHINGLE)
            if len(h) == 1 and len(hashes_of_bytes(raws[at])[1]) < SHINGLE:
                h = h[:0]
            out.append(h)
            n.append(np.array([len(h)]))
            at += 1
            continue
        end, size = at, 0
        while end < len(raws) and size + len(raws[end]) < _TOGETHER:
            size += len(raws[end]) + 1
            end += 1
        end = max(end, at + 1)
        words, first = hashes_of_bytes(b"\n".join(raws[at:end]))
        ends = np.cumsum([len(x) + 1 for x in raws[at:end]])
        per = np.diff(np.searchsorted(first, ends), prepend=0)
        at = end
        n.append(np.maximum(per - SHINGLE + 1, 0))
        if len(words) < SHINGLE:
            continue
        m = len(words) - SHINGLE + 1
        h = np.full(m, SHINGLE, dtype=np.uint64)
        for i in range(SHINGLE):
            h = _mixed(h * _ODD[i % 5] + words[i : m + i])
        text = np.repeat(np.arange(len(per)), per)
        out.append(h[text[:m] == text[SHINGLE - 1 :]])
    return np.concatenate(out), np.concatenate(n)


class _Block:
    """The shingles of some texts in one array, with the place of each text in it."""

    def __init__(self, doc_ids: list, texts: list):
        self.h, self.n = shingles_of(texts)
        self.doc_id = np.array(doc_ids, dtype=np.int64)
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n

    def centres(self, v: np.ndarray, width: int, margin: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions in order that hold the least value of some `width` positions in a row of one text, and their texts.

        margin: positions at both ends of a text that are left out. Ties go to a position drawn by its number.
        """
        per = np.maximum(self.n - 2 * margin - width + 1, 0)
        if not per.any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        bits = np.uint64(max(1, len(v).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        odd, back = np.uint64(0x9E3779B1), np.uint64(pow(0x9E3779B1, -1, 1 << 64))
        best = (v & ~low) | ((np.arange(len(v), dtype=np.uint64) * odd) & low)
        step = 1
        while step * 2 <= width:
            best, step = np.minimum(best[:-step], best[step:]), step * 2
        if step < width:
            best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
        # Places of windows inside one text; a place counts where its least value is new, as it is at the first place of a text.
        edge = np.zeros(len(best) + 1, dtype=np.int8)
        first = (self.begin + margin)[per > 0]
        edge[first] += 1
        edge[first + per[per > 0]] -= 1
        new = np.concatenate([[True], best[1:] != best[:-1]])
        new[first] = True
        at = np.flatnonzero(new & (np.cumsum(edge[:-1], dtype=np.int8) > 0))
        return ((best[at] & low) * back & low).astype(np.int64), np.searchsorted(self.end, at, side="right")

    def windows(self, f: int, width: int) -> tuple[np.ndarray, ...]:
        """Key, text, left, centre, right (in the text) of the compact windows of hash function f."""
        v = _mixed(self.h * _ODD[f] + np.uint64(f + 1))
        at, text = self.centres(v, width)
        begin, value = self.begin[text], v[at]
        left, right = _extents(value.tolist(), at.tolist(), begin.tolist(), self.end[text].tolist())
        return value.view(np.int64), text, left - begin, at - begin, right - begin

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, text and position of the anchors: the least shingle of every RUN - 2 * REACH in a row, keyed with REACH on each side.

        Two texts that share RUN shingles in a row have an anchor with one key there. Passages similar enough always do: a
        break costs 4 shingles of each side at least, so s common shingles allow s / 32 breaks, and s is 41 or more.
        """
        at, text = self.centres(self.h, RUN - 2 * REACH, REACH)
        long_enough = self.n[text] >= MIN_WORDS - SHINGLE + 1
        at, text = at[long_enough], text[long_enough]
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(-REACH, REACH + 1):
            key = _mixed(key * _ODD[0] + self.h[at + k])
        return key.view(np.int64), text, at - self.begin[text]


def _extents(value: list, at: list, begin: list, end: list) -> tuple[np.ndarray, np.ndarray]:
    """How far each position is the least of its text, given all positions that are so over some width."""
    left, right, stack, own = [0] * len(at), [e - 1 for e in end], [], None
    for i, x in enumerate(value):
        if begin[i] != own:
            stack, own = [], begin[i]
        while stack and value[stack[-1]] > x:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else own
        stack.append(i)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(left, centre, right) of every Cartesian tree node that spans at least `width` positions.

    All subsequences that lie in the span and hold the centre have their minimum there, so they share one min-hash, and the
    spans together cover every subsequence of `width` or more positions. A node that wide is the least of some `width` positions
    in a row, and so are all nodes above it; one pass over these few positions therefore gives the spans.
    """
    if len(h) < width:
        return []
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(len(h) - width + 1))
    left, right = _extents(h[at].tolist(), at.tolist(), [0] * len(at), [len(h)] * len(at))
    return list(zip(left.tolist(), at.tolist(), right.tolist()))


def _with_shingles(pdf: pd.DataFrame, chars: int = 400_000) -> Iterator[tuple]:
    """(row, shingles of ta, shingles of tb) of pairs of texts; a text that several pairs near each other have is hashed once."""
    at, size = 0, (pdf["ta"].str.len() + pdf["tb"].str.len()).to_numpy()
    cut = np.cumsum(size) // chars
    while at < len(pdf):
        end = int(np.searchsorted(cut, cut[at], side="right"))
        some, at = pdf.iloc[at:end], end
        texts = dict(zip(some["a"], some["ta"])) | dict(zip(some["b"], some["tb"]))
        h, n = shingles_of(list(texts.values()))
        held = dict(zip(texts, np.split(h, np.cumsum(n)[:-1])))
        for row in some.itertuples(index=False):
            yield row, held[row.a], held[row.b]


def _blocks(batches: Iterator[pd.DataFrame], chars: int = 500_000) -> Iterator[_Block]:
    """Some texts at a time."""
    ids, texts, held = [], [], 0
    for pdf in batches:
        for d, t in zip(pdf["doc_id"], pdf["text"]):
            ids.append(d)
            texts.append(t)
            held += len(t)
            if held >= chars:
                yield _Block(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield _Block(ids, texts)


def _around(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Passages of b that a holds too, around anchors (position in a, position in b)."""
    at, width = np.flatnonzero(np.isin(b, a)), MIN_WORDS - SHINGLE + 1
    # No passage bridges a gap of more than a quarter of what is shared.
    cuts = np.flatnonzero(np.diff(at) > len(at) // 4 + 1)
    found: set[tuple[int, int]] = set()
    tried = set()
    for pa, pb in pairs:
        k = int(np.searchsorted(cuts, np.searchsorted(at, pb)))
        lo, hi = int(at[cuts[k - 1] + 1 if k else 0]), int(at[cuts[k] if k < len(cuts) else -1]) + 1
        if hi - lo < width or (lo, pa - pb) in tried or any(x <= pb < y for x, y in found):
            continue
        tried.add((lo, pa - pb))
        a_lo, a_hi = max(0, pa - (pb - lo) * 5 // 4 - 10), pa + (hi - pb) * 5 // 4 + 10
        found.update((lo + x, lo + y) for x, y in _stretches(a[a_lo:a_hi], b[lo:hi], width))
    return sorted(found)


def _proposals(key: np.ndarray, side: np.ndarray, ids: np.ndarray, at: np.ndarray, ctx: np.ndarray, lo: int, hi: int) -> list[tuple]:
    """(key, a, b, pa, pb) for a block of open anchors of one key and a block of its holders: those of ranks lo to hi - 1.

    A holder, in an earlier document, counts when a part of a passage may lie around both anchors. An anchor with more such holders than hi gives a row without a.
    """
    mine, theirs = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    if not len(mine) or not len(theirs):
        return []
    sets = [np.frombuffer(x, dtype=np.uint32) for x in ctx]
    size = np.array([len(x) for x in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    of_mine = (side == 1)[row]
    common = np.flatnonzero((np.bincount(codes[of_mine], minlength=len(values)) > 0) & (np.bincount(codes[~of_mine], minlength=len(values)) > 0))
    if not len(common):
        return []
    number = np.full(len(values), -1)
    number[common] = np.arange(len(common))
    column, place = number[codes], np.zeros(len(sets), dtype=np.int64)
    place[mine], place[theirs] = np.arange(len(mine)), np.arange(len(theirs))
    width, n = int(size[mine].max()), size[mine]
    line = place[row[of_mine]]
    offset = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    places = np.full((len(mine), width), -1)
    places[line, offset] = column[of_mine]
    new, first = np.zeros(places.shape, dtype=bool), np.unique(line * len(values) + codes[of_mine], return_index=True)[1]
    new[line[first], offset[first]] = True
    own = ~of_mine & (column >= 0)
    has = np.zeros((len(theirs), len(common)), dtype=bool)
    has[place[row[own]], column[own]] = True
    shared, distinct = (np.zeros((len(mine), len(theirs)), dtype=np.float32) for _ in range(2))
    for k in range(0, len(common), _BLOCK_COLUMNS):
        m = min(_BLOCK_COLUMNS, len(common) - k)
        own = of_mine & (column >= k) & (column < k + m)
        times = np.bincount(place[row[own]] * m + column[own] - k, minlength=len(mine) * m).reshape(len(mine), m)
        held = has[:, k : k + m].astype(np.float32).T
        shared += times.astype(np.float32) @ held
        distinct += (times > 0).astype(np.float32) @ held
    shared[(shared < ENOUGH) | (distinct < _least(new, n)[:, None]) | (ids[theirs][None, :] >= ids[mine][:, None])] = 0
    i, j = np.nonzero(shared)
    if not len(i):
        return []
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        both = has[y[:, None], np.maximum(places[x], 0)] & (places[x] >= 0)
        fails = ~_may_hold(both, new[x], size[mine[x]]) if width >= MIN_WORDS - SHINGLE + 1 else np.ones(len(x), dtype=bool)
        shared[x[fails], y[fails]] = 0
    out = []
    for i in np.flatnonzero(shared.any(axis=1)):
        b = mine[i]
        ok = np.flatnonzero(shared[i])
        for j in ok[np.lexsort((ids[theirs[ok]], -shared[i][ok]))][lo:hi]:
            out.append((key[b], ids[theirs[j]], ids[b], at[theirs[j]], at[b]))
        if len(ok) > hi:
            out.append((key[b], None, ids[b], None, at[b]))
    return out


def _least(new: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least number of different shared shingles of each row with which _may_hold can say yes: that of the easiest part, without breaks."""
    width = MIN_WORDS - SHINGLE + 1
    if new.shape[1] < width:
        return np.zeros(len(new))
    sums = np.concatenate([np.zeros((len(new), 1), dtype=np.int64), np.cumsum(new, axis=1)], axis=1)
    d = sums[:, width:] - sums[:, :-width]
    inside = np.arange(d.shape[1])[None, :] + width <= size[:, None]
    return np.where(inside, np.maximum(PERCENT * d - 300 * d // width, 0) / 100, np.inf).min(axis=1)


def _may_hold(shared: np.ndarray, new: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For rows of shared positions (the first size of each count): whether a part of a passage may lie there.

    A break costs 4 shingles on both sides at least, so over a whole passage PERCENT of its shingles and 4 for each break are
    shared, and over some part as long as the shortest passage at least as many but for what its two ends cut through. Of a
    shingle that comes again only the first place (new) counts, as in the sets that the passages are tested with.
    """
    width = MIN_WORDS - SHINGLE + 1
    starts = np.zeros(shared.shape, dtype=bool)
    starts[:, 1:] = shared[:, :-1] & ~shared[:, 1:]
    sums = [np.concatenate([np.zeros((len(x), 1), dtype=np.int64), np.cumsum(x, axis=1)], axis=1) for x in (shared & new, ~shared & new, starts)]
    held, lone = (x[:, width:] - x[:, :-width] for x in sums[:2])
    breaks = sums[2][:, width:] - sums[2][:, 1 : 1 - width]
    inside = np.arange(held.shape[1])[None, :] + width <= size[:, None]
    slack = 300 * (held + lone) // width  # the ends of a part
    return (inside & (100 * held + slack >= PERCENT * (held + lone + 4 * breaks))).any(axis=1)


def _matched_spans(a: np.ndarray, b: np.ndarray, matches: list) -> list[tuple[int, int]]:
    """Passages of b (shingle positions, end exclusive) that a holds too, verified on the full shingle sets.

    matches: (f, left, centre, right of a's window, the same of b's). Matches whose windows overlap in b and whose centres lie
    at about one distance form a candidate when AGREE hash functions meet there. Inside it, positions of b whose shingle is in
    a's part are counted; a maximal stretch of at least the least width is kept when the sets of stretch and counterpart are
    similar enough.
    """
    width, out = MIN_WORDS - SHINGLE + 1, []
    rows = sorted(matches, key=lambda m: (m[5] - m[2], m[5]))
    groups: list[list] = []
    for m in rows:
        g = groups[-1] if groups else None
        if g and abs((m[5] - m[2]) - (g[-1][5] - g[-1][2])) <= width // 2:
            g.append(m)
        else:
            groups.append([m])
    for g in groups:
        g.sort(key=lambda m: m[4])
        clusters, reach = [], -1
        for m in g:
            if m[4] <= reach:
                clusters[-1].append(m)
            else:
                clusters.append([m])
            reach = max(reach, m[6])
        for cluster in clusters:
            if len({m[0] for m in cluster}) < AGREE:
                continue
            b_lo, b_hi = min(m[4] for m in cluster), max(m[6] for m in cluster) + 1
            a_lo, a_hi = min(m[1] for m in cluster), max(m[3] for m in cluster) + 1
            part_a, part_b = a[a_lo:a_hi], b[b_lo:b_hi]
            out += [(b_lo + lo, b_lo + hi) for lo, hi in _stretches(part_a, part_b, width)]
    return out


def _stretches(part_a: np.ndarray, part_b: np.ndarray, width: int) -> list[tuple[int, int]]:
    """All longest stretches of part_b of at least `width` positions that are similar to their counterpart in part_a.

    The counterpart may lie more than once in part_a and apart, so only its shingles that the stretch holds too count: the
    shared part must be PERCENT of the union of the two. A longest stretch starts and ends with a run of shared positions. From
    each run the furthest end that passes is taken, so the whole is tried before any part of it; stretches inside one already
    taken are left out.
    """
    is_shared = np.isin(part_b, part_a)
    at = np.flatnonzero(is_shared)
    out: list[tuple[int, int]] = []
    if len(at) < 1:
        return out
    breaks = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + 1
    order = np.argsort(part_b, kind="stable")
    before = np.full(len(part_b), -1)
    again = part_b[order[1:]] == part_b[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    # Without what was met before the stretch and with repeats: a bound that no stretch that passes is under.
    shared_to, lone_to = np.concatenate([[0], np.cumsum(is_shared)]), np.concatenate([[0], np.cumsum(~is_shared & (before < 0))])
    weight = (100 - PERCENT) * shared_to - PERCENT * lone_to
    gain = weight[last]
    best = np.maximum.accumulate(gain[::-1])[::-1]
    done = 0
    for i in np.flatnonzero((last[-1] - first >= width) & (best >= weight[first])):
        start = first[i]
        may = np.flatnonzero((last[i:] - start >= width) & (last[i:] > done) & (gain[i:] >= weight[start])) + i
        if not len(may):
            continue
        new = before[start : last[may[-1]]] < start
        held = np.cumsum(np.where(is_shared[start : last[may[-1]]], 100 - PERCENT, -PERCENT) * new)
        good = may[held[last[may] - start - 1] >= 0]
        if len(good):
            done = int(last[good[-1]])
            out.append((int(start), done))
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of MIN_WORDS or more words that are near copies of a passage in a document with a smaller doc_id.

    1. Equal texts fall together first; a copy is one span over its whole text.
    2. Keys of all compact windows are counted (pre-aggregated), and only windows with a repeated key go on.
    3. Each key links its windows to the first document that has it, alone and together with the shingle after the centre,
       so a key that a third of all documents hold gives as many rows as windows, never pairs of them.
    4. Links of two documents are gathered, joined as intervals across hash functions, and verified on the shingles.
    5. Anchors (see anchors) that no verified span explains propose again: they are compared with every holder of their key,
       block against block, on the shingles around, and the likeliest holders are verified, more of them in each round, until
       the anchor is explained or no holder is left. No pair that fails the comparison is a row.

    Returns doc_id, n_words, n_dup_words, spans (array of start, end in words), sources (doc_ids), one row for each row given.
    Null and empty texts have no words. Rows that share doc_id and text are one document; texts that differ under one doc_id are
    documents of their own, in order of their hash. A null doc_id has no spans. Repeats inside one document are not looked for.
    Other columns are not looked at.
    """
    @F.pandas_udf("long")
    def n_words(text: pd.Series) -> pd.Series:
        # bytes.split() cuts at the six separators only.
        return pd.Series([0 if t is None or t != t else len(t.encode("utf-8", "surrogatepass").split()) for t in text], dtype="int64")

    small_batches(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("text").alias(TEXT_KEY), "text")
    hashed = own.filter("doc_id is not null and text is not null").select("doc_id", TEXT_KEY, F.xxhash64(F.lit(3), F.col("text")).alias("t2"))
    heads = hashed.groupBy(TEXT_KEY, "t2").agg(F.min("doc_id").alias("head"))
    # Numbers in order of (doc_id, text key): a doc_id may come with several texts. Ranges of a sort are numbered in their order.
    heads = materialise(heads.repartitionByRange("head", TEXT_KEY, "t2").sortWithinPartitions("head", TEXT_KEY, "t2").withColumn("node", F.monotonically_increasing_id()), "heads")
    copies = materialise(hashed.join(heads, [TEXT_KEY, "t2"]).select("doc_id", TEXT_KEY, "head", "node").distinct(), "copies")
    first = copies.filter("doc_id = head").select("doc_id", TEXT_KEY, "node")
    texts = own.filter("doc_id is not null and text is not null").dropDuplicates(["doc_id", TEXT_KEY])
    texts = materialise(texts.join(first, ["doc_id", TEXT_KEY]).select(F.col("node").alias("doc_id"), "text"), "texts")

    width = MIN_WORDS - SHINGLE + 1

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            for f in range(HASHES):
                key, text, left, centre, right = block.windows(f, width)
                after = block.h[np.minimum(block.begin[text] + centre + SHINGLE, block.end[text] - 1)].view(np.int64)
                yield pd.DataFrame({"key": key, "ctx": after, "f": np.int32(f), "doc_id": block.doc_id[text], "l": left.astype(np.int32), "c": centre.astype(np.int32), "r": right.astype(np.int32)})

    # Written: they are made once and read twice, and the join may split the rows of a key that very many windows have.
    every = materialise(texts.mapInPandas(windows, "key long, ctx long, f int, doc_id long, l int, c int, r int"), "all_windows")
    repeated = materialise(_in_two_documents(every).select("key"), "repeated_keys")
    live = materialise(every.join(repeated, "key"), "windows")
    discard(every)

    def links(*by: str) -> DataFrame:
        first = live.groupBy(*by).agg(F.min(F.struct("doc_id", "l", "c", "r")).alias("a"), F.max("doc_id").alias("z")).filter("a.doc_id < z").drop("z")
        first = materialise(first, "first_holders")
        return live.join(first, list(by)).filter("doc_id > a.doc_id").select(F.col("a.doc_id").alias("a"), F.col("doc_id").alias("b"), F.struct("f", "a.l", "a.c", "a.r", F.col("l").alias("bl"), F.col("c").alias("bc"), F.col("r").alias("br")).alias("m"))

    pairs = links("key").unionByName(links("key", "ctx")).groupBy("a", "b").agg(F.collect_set("m").alias("m"))
    pairs = pairs.filter(F.size(F.array_distinct(F.transform("m", lambda x: x["f"]))) >= AGREE)
    pairs = materialise(pairs.withColumn("m", _flat("m", *_MATCH)), "passage_pairs")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, a, b in _with_shingles(pdf):
                rows += [(x.b, lo, hi + SHINGLE - 1, x.a) for lo, hi in _matched_spans(a, b, x.m.reshape(-1, len(_MATCH)).tolist())]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "source"])

    both = _with_texts(pairs, texts)
    spans = materialise(both.mapInPandas(verify, _SPANS), "spans")
    spans = _by_anchors(texts, spans)
    sources = spans.join(heads.select(F.col("node").alias("source"), F.col("head").alias("of")), "source")
    gathered = sources.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("of")).alias("sources"))
    gathered = gathered.select(F.col("doc_id").alias("node"), _merged("spans").alias("spans"), "sources")

    counted = own.select("doc_id", TEXT_KEY, n_words("text").alias("n_words"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    # Only the first document of a text has spans of its own, so the join by node has no hot key.
    columns = ["doc_id", TEXT_KEY, "head", "spans", "sources"]
    with_spans = copies.filter("doc_id = head").join(gathered, "node", "left").select(columns)
    with_spans = with_spans.unionByName(copies.filter("doc_id > head").select("doc_id", TEXT_KEY, "head"), allowMissingColumns=True)
    out = counted.join(with_spans, ["doc_id", TEXT_KEY], "left")
    copy = (F.col("head") < F.col("doc_id")) & (F.col("n_words") >= MIN_WORDS)
    return out.withColumn("spans", F.when(copy, whole).otherwise(F.coalesce("spans", empty))).select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_dup_words"), "spans",
        F.when(copy, F.array("head")).otherwise(F.coalesce("sources", F.array().cast("array<bigint>"))).alias("sources"))


_SPANS = "doc_id long, start long, end long, source long"
_MATCH = ("f", "l", "c", "r", "bl", "bc", "br")


def _in_two_documents(rows: DataFrame) -> DataFrame:
    """The keys that more than one document has, and the first of these."""
    return rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("z")).filter("least < z").drop("z")


def _flat(structs: str | Column, *fields: str) -> Column:
    """An array of structs as one array of numbers, which reaches Python as a numpy array."""
    return F.flatten(F.transform(structs, lambda x: F.array(*(x[f].cast("long") for f in fields))))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, m of pairs, and the texts of a and b."""
    return (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "m", "ta", "tb"))


def _common_enough(rows: DataFrame) -> DataFrame:
    """The anchors with ENOUGH positions around them whose shingles lie around another anchor of the key too; no other finds a partner.

    A shingle that one anchor of a key has alone is a group of one row, which names its anchor, so the shingles are grouped once
    and joined with nothing. Not part of repeated_passages any more: each shingle around each anchor is a row here.
    """

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                sets = [np.frombuffer(x, dtype=np.uint32) for x in some["ctx"]]
                row = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
                code, n = np.unique(row << 32 | np.concatenate(sets).astype(np.int64), return_counts=True)
                row = code >> 32
                yield pd.DataFrame({c: some[c].to_numpy()[row] for c in ("key", "doc_id", "p")} | {"s": code & 0xFFFFFFFF, "n": n})

    each = rows.select("key", "doc_id", "p", "ctx").mapInPandas(shingles, "key long, doc_id long, p long, s long, n long")
    alone = each.groupBy("key", "s").agg(F.count("*").alias("holders"), *(F.min(c).alias(c) for c in ("doc_id", "p", "n"))).filter("holders = 1")
    lone = alone.groupBy("key", "doc_id", "p").agg(F.sum("n").alias("lone"))
    held = F.length("ctx") / 4 - F.coalesce("lone", F.lit(0))
    return rows.join(lone, ["key", "doc_id", "p"], "left").filter(held >= ENOUGH).select(rows.columns)


def _by_anchors(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """spans, and those of the passages that only the anchors outside of them lead to."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            key, text, at = block.anchors()
            yield pd.DataFrame({"key": key, "doc_id": block.doc_id[text], "p": at.astype(np.int32)})

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = MIN_WORDS - SHINGLE
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some, rows = pdf.iloc[at : at + 256], {}
                h, n = shingles_of(some["text"].tolist())
                h, end = h.astype(np.uint32), np.cumsum(n)
                for d, each, lo, hi in zip(some["doc_id"], some["each"], (end - n).tolist(), end.tolist()):
                    for key, p, is_open in each.reshape(-1, 3).tolist():
                        # Anchors of a document that look alike all around need one row.
                        rows.setdefault((key, d, h[max(lo, lo + p - far) : min(hi, lo + p + far + 1)].tobytes(), bool(is_open)), p)
                yield pd.DataFrame([(key, d, p, is_open, ctx) for (key, d, ctx, is_open), p in rows.items()], columns=["key", "doc_id", "p", "open", "ctx"])

    def explained(rows: DataFrame, by: DataFrame) -> DataFrame:
        """open: no span of the document holds all words of the anchor's key."""
        held = by.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")).select("doc_id", _merged("_spans").alias("_spans"))
        inside = F.exists("_spans", lambda x: (x["start"] <= F.col("p") - REACH) & (x["end"] >= F.col("p") + REACH + SHINGLE))
        return rows.join(held, "doc_id", "left").withColumn("open", F.col("open") & ~F.coalesce(inside, F.lit(False))).drop("_spans")

    def with_open(rows: DataFrame) -> DataFrame:
        """Only the keys that still have open anchors."""
        return rows.join(rows.filter("open").select("key").distinct(), "key", "left_semi")

    places = materialise(texts.mapInPandas(keys, "key long, doc_id long, p int"), "all_anchors")
    repeated = materialise(_in_two_documents(places), "repeated_anchors")
    live = places.join(repeated, "key").withColumn("open", F.col("doc_id") > F.col("least")).drop("least")
    live = materialise(explained(live, spans), "anchors")
    discard(places)
    each = with_open(live).groupBy("doc_id").agg(F.collect_list(F.struct("key", "p", F.col("open").cast("int").alias("open"))).alias("each"))
    each = each.withColumn("each", _flat("each", "key", "p", "open")).join(texts, "doc_id")
    rest = materialise(each.select("doc_id", "text", "each").mapInPandas(contexts, "key long, doc_id long, p long, open boolean, ctx binary"), "contexts")
    # Of holders that look alike all around an anchor, the first stands for all.
    first = rest.groupBy("key", F.xxhash64("ctx").alias("like")).agg(F.min("doc_id").alias("doc_id"))
    marked = rest.withColumn("like", F.xxhash64("ctx"))
    rest = marked.filter("open").unionByName(marked.filter("NOT open").join(first, ["key", "like", "doc_id"], "left_semi")).drop("like")
    rest = materialise(with_open(rest), "contexts")

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, a, b in _with_shingles(pdf):
                rows += [(x.b, lo, hi + SHINGLE - 1, x.a) for lo, hi in _around(a, b, sorted(map(tuple, x.m.reshape(-1, 2).tolist())))]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "source"])

    group = ["key", "mine", "theirs"]
    for turn in count():
        low, high = (0 if not turn else 4 * 16 ** (turn - 1)), 4 * 16**turn  # holders that an open anchor proposes in a block
        if not rest.filter("open").take(1):
            break
        n_blocks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / _BLOCK_ANCHORS).cast("int")
        blocks = rest.groupBy("key").agg(n_blocks(F.count_if("open")).alias("n_mine"), n_blocks(F.count("*")).alias("n_theirs"))
        numbered = rest.join(blocks, "key").withColumn("h", F.xxhash64("doc_id", "p"))
        upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        as_open = numbered.filter("open").withColumn("mine", F.pmod("h", F.col("n_mine")).cast("int")).withColumns({"theirs": F.explode(upto("n_theirs")), "side": F.lit(1)})
        as_held = numbered.withColumn("theirs", F.pmod("h", F.col("n_theirs")).cast("int")).withColumns({"mine": F.explode(upto("n_mine")), "side": F.lit(0)})

        def propose(batches: Iterator[pd.DataFrame], low: int = low, high: int = high) -> Iterator[pd.DataFrame]:
            # Groups lie together; the last one of a batch waits for the next batch.
            wait, columns = None, ["key", "a", "b", "pa", "pb"]
            columns_of = lambda pdf: [pdf[c].to_numpy() for c in ("key", "side", "doc_id", "p", "ctx")]
            for pdf in batches:
                pdf = pdf if wait is None else pd.concat([wait, pdf], ignore_index=True)
                own = pdf[group].to_numpy()
                ends = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist()]
                of = columns_of(pdf)
                rows = [r for x, y in zip(ends, ends[1:]) for r in _proposals(*(c[x:y] for c in of), low, high)]
                yield pd.DataFrame(rows, columns=columns).astype("Int64")
                wait = pdf.iloc[ends[-1] :]
            if wait is not None and len(wait):
                yield pd.DataFrame(_proposals(*columns_of(wait), low, high), columns=columns).astype("Int64")

        columns = [*group, "side", "doc_id", "p", "ctx"]
        near = as_open.select(columns).unionByName(as_held.select(columns)).repartition(*group).sortWithinPartitions(*group)
        proposed = materialise(near.mapInPandas(propose, "key long, a long, b long, pa long, pb long"), "proposals")
        pairs = proposed.filter("a is not null").groupBy("a", "b").agg(_flat(F.collect_set(F.struct("pa", "pb")), "pa", "pb").alias("m"))
        both = _with_texts(pairs, texts)
        if turn:  # few documents are left
            of = materialise(proposed.filter("a is not null").select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "of_proposals")
            both = _with_texts(pairs, texts.join(of, "doc_id", "left_semi"))
        found = materialise(both.mapInPandas(around, _SPANS), "spans")
        spans = spans.unionByName(found)
        more = proposed.filter("a is null").select("key", F.col("b").alias("doc_id"), F.col("pb").alias("p"), F.lit(True).alias("more")).distinct()
        left = explained(rest, found).join(more, ["key", "doc_id", "p"], "left").withColumn("open", F.col("open") & F.coalesce("more", F.lit(False))).drop("more")
        rest = materialise(with_open(left), "contexts")
    return spans


def _merged(spans: str):
    """Overlapping spans of a sorted array become one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, add)
