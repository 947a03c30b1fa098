"""Token ids of documents, and their binary files: zstandard frames with a trailing seek table."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import TwoGenerations, scratch_path, small_batches, worker_cache

#: Bytes of distinct pieces and their ids kept in each Python worker, twice; characters of the texts encoded together.
CACHED_BYTES, BLOCK_CHARS = 60_000_000, 8_000_000


#: White space beside white space or at an end: there a cut could change pieces that keep their space.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_SPACE = rf"{_SPACES}{_SPACES}|^{_SPACES}|{_SPACES}$"
#: Marks of which a run behind a letter, at the end of a piece, is a piece of the pre-tokenizers of both files.
MARKS = ".,!?;:#$%&*+-/<=>@^_|~()[]{}\""
#: A mark between a letter and a single space or line end.
_MARK = r"(\p{L})([.,])[ \n]"
#: The same behind Latin letters, which are letters in every version of Unicode's tables, with what follows.
_LATIN_MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,])([ \n])"


def _byte_letters() -> dict[int, str]:
    """Byte-level files write each byte as a printable character: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """A public tokenizer with a cache of pieces.

    Texts are cut at single spaces and line ends between two visible characters, where the pre-tokenizers of both files always
    end a piece, so the ids of a text are those of its pieces. With keep_space (byte-level files) a piece keeps the space
    before it, and a . or , between a Latin letter and such a space is a piece of its own, since there a run of letters ends; a text
    with white space beside white space is encoded whole, as is any text that holds a special token.
    Without it the file lower-cases: a text of Latin-1 characters, where that is letter by letter, is lower-cased first and also
    cut before a . or , that ends a word, since there a run of letters ends, so that forms of one word are one piece. The
    pieces of a block of texts are numbered by Arrow's dictionary encoding, so Python sees each distinct one once. A new piece
    of letters, with a run of MARKS after them perhaps, goes straight to the tokenizer's model; any other goes through the whole
    tokenizer.
    """

    def __init__(self, path: str, keep_space: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep_space = keep_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = TwoGenerations(CACHED_BYTES)
        self.bytes = _byte_letters()
        self.space = self.bytes[32]
        self.marks = {"": b""}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, texts: list[str]) -> list[str | None]:
        """Each text with \\0 between its pieces; None where it has to be encoded whole."""
        whole = ["\0" in t or any(s in t for s in self.special) for t in texts]
        if not self.keep_space:
            texts = self._plain_forms(texts, whole)
            return [None if w else t.replace("\n", "\0").replace(" ", "\0") for t, w in zip(texts, whole)]
        texts = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_pylist()
        texts = pc.replace_substring_regex(texts, _LATIN_MARK, "\\1\0\\2\\3").to_pylist()
        return [None if w or o else t.replace("\n", "\0\n\0").replace(" ", "\0 ") for t, w, o in zip(texts, whole, odd)]

    def _plain_forms(self, texts: list[str], whole: list[bool]) -> list[str]:
        """Latin-1 texts lower-cased and with \\0 on both sides of marks that end a word; other texts, and those that are encoded whole, as they are."""
        out, at = list(texts), []
        for i, (t, w) in enumerate(zip(texts, whole)):
            if w or not (t.isascii() or max(t) <= "\xff"):
                continue
            t = t.lower()
            if not any(s in t for s in self.special):  # in capitals it is no special token
                out[i] = t
                at.append(i)
        marked = pc.replace_substring_regex(pa.array([out[i] for i in at], pa.large_string()), _MARK, "\\1\0\\2\0")
        for i, t in zip(at, marked.to_pylist()):
            out[i] = t
        return out

    def _tail(self, run: str) -> bytes:
        """Ids of a run of marks behind a letter."""
        ids = self.marks.get(run)
        if ids is None:
            ids = self._plain(run)
            if len(run) <= 4 and len(self.marks) < 10_000:
                self.marks[run] = ids
        return ids

    def _raw(self, core: str) -> str | None:
        """What the model gets for letters that need no normalising but lower case, perhaps after a space; None for anything else."""
        letters = core[1:] if core[:1] == " " else core
        if not letters.isalpha() or not (letters.isascii() or max(letters) < "\u0250"):
            return None
        raw = core if self.keep_space else core.lower()
        if not self.keep_space and not raw.isalpha():  # a dotted capital I becomes a letter and a mark
            return None
        return raw.replace(" ", self.space) if raw.isascii() else raw.encode().decode("latin-1").translate(self.bytes)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        cache, out = self.cache, list(map(self.cache.young.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if cache.old:
            old = list(map(cache.old.get, [pieces[i] for i in missing]))
            for i, x in zip(missing, old):
                if x is not None:
                    out[i] = x
                    cache.put(pieces[i], x)
            missing = [i for i, x in zip(missing, old) if x is None]
        rest, learnt, tails, flat, ends = [], [], {}, [], [0]
        tokenize, space, keep_space = self.model.tokenize, self.space, self.keep_space
        for i in missing:
            p = pieces[i]
            if keep_space and p.isascii() and p[1:].isalpha() and p[0] == " ":
                raw = space + p[1:]
            else:
                core, tail = p, b""
                if p[-1:] in MARKS:
                    core = p.rstrip(MARKS)
                    tail = self._tail(p[len(core) :])
                # Marks join what stands before them unless that is a letter, also in lower case: a dotted capital I ends in a mark there.
                stem = cache.get(core) if tail and core[-1:].isalpha() and (keep_space or core[-1] != "\u0130") else None
                if stem is not None:
                    out[i] = stem + tail
                    cache.offer(p, out[i])
                    continue
                raw = self._raw(core)
                if raw is None:
                    rest.append(i)
                    continue
                if tail:
                    tails[i] = tail
            flat += [t.id for t in tokenize(raw)]
            ends.append(len(flat))
            learnt.append(i)
        # The ids of all new words become bytes at once.
        together = np.array(flat, dtype="<u4").tobytes()
        for i, lo, hi in zip(learnt, ends, ends[1:]):
            out[i] = together[4 * lo : 4 * hi] + tails.get(i, b"") if tails else together[4 * lo : 4 * hi]
        cache.offer_all([pieces[i] for i in learnt], [out[i] for i in learnt])
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
                cache.offer(pieces[i], out[i])
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        cut = self._cut(texts)
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\0")
        coded = lists.flatten().dictionary_encode()
        known = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        _, ends, flat = ids.buffers()
        places = (np.frombuffer(ends, dtype=np.int64, count=len(ids) + 1, offset=8 * ids.offset)[lists.offsets.to_numpy()] // 4).tolist()
        flat = np.frombuffer(flat or b"", dtype="<u4", count=places[-1])
        return [flat[places[i] : places[i + 1]] if c is not None else np.frombuffer(self._plain(t), dtype="<u4") for i, (t, c) in enumerate(zip(texts, cut))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text its ids as unsigned 32-bit integers, block by block."""
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= BLOCK_CHARS:
                yield from self._block(some)
                some, held = [], 0
        if some:
            yield from self._block(some)


def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """The worker's encoder: one at a time, so that jobs with other files do not add up in a worker's memory."""
    cache = worker_cache("encoders")
    if (path, keep_space) not in cache:
        cache.clear()
        cache[path, keep_space] = PieceEncoder(path, keep_space)
    return cache[path, keep_space]


# --- file format -----------------------------------------------------------------------------------------------------
# One zstandard frame a document, holding its ids as little-endian uint32; then a skippable frame with the number of leading
# documents that have no doc_id and the doc_ids (int64, 0 for those); then the seek table of zstandard's public seekable format: a skippable frame of (compressed size, decompressed size,
# checksum: low 32 bits of XXH64) for each frame, the number of frames, a descriptor byte and a magic number.

#: Fixed values of zstandard's frame and seekable formats.
SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEKABLE_MAGIC, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def _open(path: str, mode: str):
    """A file of the shared folder: file: URIs directly, other stores through Arrow's file systems."""
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        return open("/" + path.lstrip("/"), mode)
    if path.startswith("/"):
        return open(path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def _publish(temporary: str, final: str) -> None:
    """The whole file appears at once, so a lost or repeated task leaves no half file behind."""
    if temporary.startswith(("file:", "/")):
        plain = lambda p: "/" + p.removeprefix("file:").lstrip("/")
        os.replace(plain(temporary), plain(final))
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(temporary)
        store.move(inner, fs.FileSystem.from_uri(final)[1])


def _make_folder(path: str) -> None:
    if path.startswith(("file:", "/")):
        os.makedirs("/" + path.removeprefix("file:").lstrip("/"), exist_ok=True)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner, recursive=True)


def write_file(path: str, documents: Iterator[tuple[int | None, bytes]], level: int = 1) -> tuple[int, int, int]:
    """Write (doc_id, ids) pairs in the order given, null doc_ids first; returns the number of documents, ids and bytes."""
    import xxhash
    import zstandard

    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    temporary = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.tmp"
    doc_ids, entries, n_null, n_ids, size = [], [], 0, 0, 0
    with _open(temporary, "wb") as out:
        for doc_id, raw in documents:
            frame = press.compress(raw)
            out.write(frame)
            n_null += doc_id is None
            doc_ids.append(doc_id or 0)
            entries.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            n_ids += len(raw) // 4
            size += len(frame)
        names = np.array([n_null, *doc_ids], dtype="<i8").tobytes()
        table = b"".join(entries) + struct.pack("<IBI", len(entries), HAS_CHECKSUM, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_IDS, len(names)) + names + struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table
        out.write(tail)
    _publish(temporary, path)
    return len(doc_ids), n_ids, size + len(tail)


class TokenFile:
    """Random access to a token file: reads the tables at the end, then only the frames that are asked for."""

    def __init__(self, path: str):
        self.f = _open(path, "rb")
        self.f.seek(0, 2)
        end = self.f.tell()
        self.f.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", self.f.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != HAS_CHECKSUM:
            raise ValueError(f"{path} has no seek table")
        tail = 12 * n + 9
        self.f.seek(end - tail - 16 - 8 * n)
        raw = self.f.read(8 * n + 16 + tail)
        self.n_null, self.doc_ids = struct.unpack("<q", raw[:8])[0], np.frombuffer(raw, dtype="<i8", count=n, offset=8)
        entries = np.frombuffer(raw, dtype="<u4", count=3 * n, offset=8 * n + 16).reshape(n, 3)
        self.sizes, self.lengths, self.sums = entries[:, 0].astype(np.int64), entries[:, 1], entries[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids_bytes(self, i: int) -> bytes:
        import xxhash
        import zstandard

        self.f.seek(int(self.offsets[i]))
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.sizes[i])), max_output_size=int(self.lengths[i]) or 1)
        if len(raw) != self.lengths[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def close(self) -> None:
        self.f.close()


# --- jobs ------------------------------------------------------------------------------------------------------------


def encoded(texts: list, path: str, keep_space: bool, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text (null: none) and the end id."""
    end = np.array([end_id], dtype="<u4")
    return (np.concatenate([x, end]) for x in encoder(path, keep_space).encode(["" if t is None or t != t else t for t in texts]))


def rest(path: str, keep_space: bool) -> None:
    """At the end of a task: what the next one may do without goes, so that a waiting worker is small."""
    encoder(path, keep_space).cache.shrink()
    pa.default_memory_pool().release_unused()


def blocks(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """Batches in slices of a few rows, so that what is made of them stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, keep_space: bool = True, end_id: int = 2) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order as files of one range of ids each.

    Returns the manifest: path, part (files in order), n_docs, n_tokens, start (ids in all files before), one row a file.
    A task streams its documents into its file and holds one block at a time; a repeated task writes the same bytes again and
    renames them into place. Null texts are empty and hold the end id only; rows that repeat a doc_id are written each, in the
    order of their texts; rows with a null doc_id are written first. An empty table gives an empty manifest. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "token_files")
    _make_folder(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.tok.zst"
        pairs = ((None if d is pd.NA else d, x.tobytes()) for pdf in blocks(batches)
                 for d, x in zip(pdf["doc_id"].astype("Int64"), encoded(pdf["text"].tolist(), tokenizer, keep_space, end_id)))
        first = next(pairs, None)
        if first is None:
            return
        n_docs, n_tokens, size = write_file(path, (x for some in ([first], pairs) for x in some))
        rest(tokenizer, keep_space)
        yield pd.DataFrame({"path": [path], "part": [part], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [size]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "path string, part int, n_docs long, n_tokens long, n_bytes long"
    rows, start = [], 0
    for r in sorted(ordered.mapInPandas(write, schema).collect(), key=lambda r: r.part):  # one short row a file
        rows.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, schema + ", start long")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and on request ids (binary)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                f = TokenFile(path)
                for at in range(0, len(f), 1024):
                    raw = [f.ids_bytes(i) for i in range(at, min(at + 1024, len(f)))]
                    n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                    ids = pd.array(f.doc_ids[at : at + len(raw)], dtype="Int64")
                    ids[: max(0, f.n_null - at)] = pd.NA
                    out = {"doc_id": ids, "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in raw]}
                    yield pd.DataFrame(out | ({"ids": raw} if with_ids else {}))
                    start += int(n.sum())
                f.close()

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
