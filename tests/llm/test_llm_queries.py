"""The registered queries against brute force on the smallest tables, and the operators on awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import centroids, common, decontaminate, language, lines, neardup, negatives, packing, passages, quality, sharding, simhash, tokens, urls
from marketloom.llm.components import connected_components
from marketloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def run(spark, name):
    return next(f for k, f in queries().items() if k.startswith(name))(spark, SF).toPandas()


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (7, "x\ny\nz\nx\ny\nz"),
           (8, "same " * 3000), (9, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600\nl2\nl3"), (10, "word\u00a0space \u2028 12.5 kg")]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, "kept", i, "clash", 0.5) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n long, part string, score double").repartition(3)


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.filter("doc_id < 0")


# --- 1 ---

def brute_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    held = set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            held.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(held)


def test_quality_counts(spark, documents):
    got = run(spark, "op1_").set_index("doc_id")
    assert len(got) == len(documents)
    for d, t in zip(documents.doc_id, documents.text):
        want = brute_quality(t)
        r = got.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_awkward(awkward, nothing):
    got = quality.score_quality(awkward).toPandas()
    assert len(got) == len(AWKWARD) and not got.set_index("doc_id").loc[[1, 2, 3, 4]].kept.any()
    assert quality.score_quality(nothing).count() == 0


def test_quality_agrees_with_labels(spark):
    """The posterior is held against labels that it never saw; it does better than the base rules alone."""
    folder = "/root/testdata/sf0.01"
    got = quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("good")), "doc_id").toPandas()
    by_kept, by_base = (got.kept == (got.good == 1)).mean(), (~got.base_failed == (got.good == 1)).mean()
    assert len(got) > 300 and by_kept > 0.95 and by_kept > by_base + 0.02
    rank = got.quality.rank()
    good = got.good == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95


def test_votes_recover_planted_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.7
    acc = np.array([0.9, 0.85, 0.75, 0.8])
    votes = np.where(r.random((20000, 4)) < acc, good[:, None], ~good[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.fit_votes(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03 and np.abs(table[:, 1, 1] - acc).max() < 0.03


# --- 2 ---

def test_token_files(spark, documents):
    got = run(spark, "op2_").sort_values("doc_id")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    texts = documents.sort_values("doc_id")
    for (d, text), r in zip(zip(texts.doc_id, texts.text), got.itertuples()):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_like_whole_texts(name, keep):
    e = tokens.PieceEncoder(public_tokenizers.path(name), keep)
    texts = [t or "" for _, t in AWKWARD] + ["a  b", " lead", "trail ", "it's we'll  I'D \n x", "x \ty", "A\u0301 e\u0301 \u03a3\u03c3\u03c2 \u03a3", "<|endoftext|> a", "tab\t b \r\n c", "3 4.5,6 %%% $$"]
    for t, raw in zip(texts, e.encode(texts)):
        assert raw.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_like_a_fresh_tokenizer(name, keep):
    r = np.random.default_rng(4)
    signs = list("abcXYZ\u00e9\u00c9\u0130\u0131\u017f\u212a\u0301\u4e2d\u0e33 \n\n  .,'\u2019!&%0123\t\r\x00\x85\xa0\u2028\u3000\U0001f600") + [" ", "'s", "<|endoftext|>", "<|startoftext|>", " and ", "The "]
    texts = ["".join(signs[i] for i in r.integers(0, len(signs), r.integers(1, 30))) for _ in range(4000)] + ["\u0130stanbul x", "x <|endoftext|> y", "a\u0130b. \u0130,"]
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    for t, ids in zip(texts, tokens.PieceEncoder(public_tokenizers.path(name), keep).encode(texts)):
        assert ids.tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_do_not_depend_on_what_came_before(name, keep):
    """Each piece comes three times, alone and with a mark, in texts of one encoder."""
    r = np.random.default_rng(12)
    letters = list("aZ\u00e9\u0130\u0131\u01c5\u1e9e\u0345\u0301\ufb01\u2126\u00df\u03a3\u0e33\u4e2d1\u00b2") + ["I\u0307", "s\u0307"]
    words = ["\u0130", "x\u0130", "\u0130x"] + ["".join(letters[i] for i in r.integers(0, len(letters), r.integers(1, 5))) for _ in range(1500)]
    texts = [f"{p}{w}{m}" for w in words for p in ("", " ") for m in ("", ".", ",", ".,", "..")] * 3
    e, fresh = tokens.PieceEncoder(public_tokenizers.path(name), keep), Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for i in range(0, len(texts), 1000) for x in e.encode(texts[i : i + 1000])]
    assert [(t, a) for t, a, b in zip(texts, got, want) if a != b] == []


def test_kept_pieces_are_found_without_a_call(monkeypatch):
    """Pieces of the cache's young half come in one pass; only the others are asked for one by one."""
    own = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = ["river stone, river cloud.", "", "stone cloud; river\nlamp"]
    first = [x.tolist() for _ in range(3) for x in own.encode(texts)][-3:]
    asked = []
    monkeypatch.setattr(own.cache, "get", lambda key: asked.append(key))
    assert [x.tolist() for x in own.encode(texts)] == first and not asked


def test_forms_of_a_word_are_one_piece(monkeypatch):
    """Capitals and marks do not make a word new, in texts where lower case is letter by letter."""
    own = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = ["River, river. RIVER\nriver, \u00c9t\u00e9. \u00e9t\u00e9", "<|ENDOFTEXT|> a. b, c", "a). b.. c,. d. , e.", "\u0130. \u0130, \u03a3. J\u030c, H\u0331. x"]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked, ids = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda pieces: asked.append(pieces) or ids(pieces))
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [x.tolist() for x in own.encode(texts[:1])] == want[:1] and sorted(asked[1]) == [",", ".", "river", "\u00e9t\u00e9"]


def test_marks_are_pieces_of_their_own_where_spaces_are_kept(monkeypatch):
    own = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = ["a river, a river. a river\n\u00c9t\u00e9.\n\u00c9t\u00e9, x", "a.b c,. d. , e.", "\u4e2d. \u00d7. \u02b0. \u0130. 3. x'. A\u0301. y"]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked, ids = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda pieces: asked.append(pieces) or ids(pieces))
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [x.tolist() for x in own.encode(texts[:1])] == want[:1] and sorted(asked[1]) == sorted(["a", " river", ",", " a", ".", "\n", "\u00c9t\u00e9", " x"])


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_runs_of_marks_behind_new_words_need_no_whole_tokenizer(name, keep):
    r = np.random.default_rng(17)
    e, fresh = tokens.PieceEncoder(public_tokenizers.path(name), keep), Tokenizer.from_file(public_tokenizers.path(name))
    letters, marks = list("abcxyzABZ\u00e4\u00f1\u00c9\u0130\u0131\u00df"), [*tokens.MARKS, "'", "1", "\u0301"]
    word = lambda x, n: "".join(r.choice(x, int(n)))
    texts = [" ".join(word(letters, r.integers(1, 9)) + word(marks, r.choice([0, 1, 2, 3, 7])) for _ in range(40)) for _ in range(250)]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == fresh.encode(t, add_special_tokens=False).ids, t
    whole = []

    class Counted:
        def __getattr__(self, key):
            return getattr(fresh, key)

        def encode_batch_fast(self, pieces, **more):
            whole.extend(pieces)
            return fresh.encode_batch_fast(pieces, **more)

    e.tokenizer = Counted()
    list(e.encode(["Neuwort!! andereswort*** drittes$$$ noch-eins viertes?! ende."]))
    assert {x.strip() for x in whole} == {"noch-eins"}


def test_piece_cache_holds_few_bytes():
    cache = common.TwoGenerations(10_000)
    for i in range(1000):
        cache.put(f"k{i}", b"12345678")
    assert cache.get("k999") == b"12345678" and cache.get("k1") is None
    assert len(cache.young) + len(cache.old) <= 2 * 10_000 // 150


def test_token_file_random_access(tmp_path):
    docs = [(i, np.arange(i * 3, dtype="<u4").tobytes()) for i in range(50)]
    path = str(tmp_path / "x.zst")
    assert tokens.write_file(path, iter(docs))[:2] == (50, sum(3 * i for i in range(50)))
    f = tokens.TokenFile(path)
    assert f.doc_ids.tolist() == list(range(50)) and f.ids_bytes(17) == docs[17][1] and f.ids_bytes(0) == b""
    import zstandard

    raw = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(x for _, x in docs)
    broken = bytearray(raw)
    broken[int(f.offsets[20]) + 12] ^= 255
    (tmp_path / "y.zst").write_bytes(broken)
    with pytest.raises(Exception):
        tokens.TokenFile(str(tmp_path / "y.zst")).ids_bytes(20)


def test_token_files_awkward(awkward, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.read_token_files(tokens.write_token_files(awkward, path), with_ids=True).toPandas().set_index("doc_id")
    assert len(got) == len(AWKWARD) and got.loc[1].n_tokens == 1 and bytes(got.loc[1].ids) == b"\x02\0\0\0"
    assert tokens.read_token_files(tokens.write_token_files(nothing, path)).count() == 0


def test_token_files_null_and_repeated_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "no id b"), (3, "three"), (None, "no id a"), (0, "zero"), (-5, None), (3, "drei")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = Tokenizer.from_file(path)
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    for _ in range(2):
        got = tokens.read_token_files(tokens.write_token_files(docs.repartition(3), path), with_ids=True).orderBy("start").collect()
        assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want


# --- 3 ---

def test_decontamination(spark):
    items = spark.createDataFrame([(1, "A train leaves London at 9 hours and travels 300 km to reach Paris before 12 hours pass.", 0), (2, "the colour of the old barn was faded red after many dry summers in the valley", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, id int")
    docs = spark.createDataFrame([
        (1, "Prologue text here. A train leaves London at 9 hours and travels 300 km to reach Paris before 12 hours pass. More."),
        (2, "Other words. A train leaves Madrid at 7 hours and travels 450 km to reach Rome before 11 hours pass."),
        (3, "Other words. A train leaves Madrid at 7 hours and travels 450 km to reach Madrid before 11 hours pass."),
        (4, "nothing of the kind is written in this short text about trains and barns at all"),
        (5, "so THE COLOUR OF THE OLD BARN was faded, red after many dry summers"), (6, None), (7, ""), (8, "the the the the the the the the the the")],
        "doc_id long, text string")
    got = decontaminate.find_contamination(docs, items).toPandas().set_index("doc_id")
    assert sorted(got.index) == [1, 2, 5]
    assert got.loc[1].verbatim and not got.loc[2].verbatim and got.loc[5].item_id == 2
    marked = decontaminate.mark_contamination(docs, items).toPandas()
    assert len(marked) == 8 and marked.contaminated.sum() == 3
    assert decontaminate.find_contamination(docs, items.filter("item_id < 0")).count() == 0
    assert decontaminate.find_contamination(docs.filter("doc_id < 0"), items).count() == 0


def test_decontamination_checks_slots_on_windows_only(spark):
    word = lambda c, n: " ".join(f"{c}{chr(97 + i)}x" for i in range(n))
    items = spark.createDataFrame([(1, f"{word('p', 12)} 5 {word('q', 12)} 5 {word('r', 12)}"), (2, f"{word('s', 12)} 7 {word('t', 12)} 7 and {word('u', 12)}")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"{word('p', 12)} 5 {word('q', 12)} 6 {word('r', 12)}"),
        (2, f"{word('s', 12)} 8 {word('t', 12)} 9 or {word('u', 12)}"),
        (3, f"{word('s', 12)} 8 {word('v', 12)} 9 or {word('w', 12)}")], "doc_id long, text string")
    got = decontaminate.find_contamination(docs, items).toPandas().set_index("doc_id")
    assert {d: got.item_id[d] for d in (1, 2, 3)} == {1: 1, 2: 2, 3: 2} and not got.verbatim.any()
    assert got.n_windows[1] < 39 - 8


def test_decontamination_is_blind_to_case(spark):
    text = "A train leaves London at 9 hours and travels 300 km to reach Paris, Texas, before 12 hours pass in New York."
    items = spark.createDataFrame([(1, text, "x")], "item_id long, text string, form string")
    docs = spark.createDataFrame([(1, "so: " + text.lower()), (2, text.upper()), (3, "then " + text.replace("London", "Madrid").replace("9", "7")), (4, text.lower().replace("london", "madrid").replace("paris", "rome").replace("texas", "maine").replace("train", "bus")),
                                  (None, text), (5, text), (5, text), (6, "word " * 30_000 + text)], "doc_id long, text string")
    got = decontaminate.find_contamination(docs.withColumn("h", decontaminate.F.lit("clash")), items).toPandas()
    assert sorted(got.doc_id) == [1, 2, 3, 5, 6] and not got.set_index("doc_id").verbatim[3]
    assert decontaminate.mark_contamination(docs, items).count() == 8


_PUZZLES = [
    "{n0} has {a} pens. {n1} has {b} pens. {n2} gets {c} more from the teacher after lunch.",
    "{n0} asked {n1}, {n2}, {n3} and {n4} to bring {a} red apples each for the school party.",
    "A bus leaves {p0} at {a} hours and travels {b} km to {p1} before it turns back at noon.",
    "In {p0} the price of bread rose by {a} percent, while in {p1} it fell by {b} percent within a year.",
    "{n0} walks {a} km every morning. {n1} walks twice as far, and {n2} rides a bicycle to {p0} instead.",
    "If {n0} buys {a} kg of rice for {b} dollars, how much does {n1} pay for {c} kg of the same rice?",
]
_NAMES = ["Anna", "Ben", "Cara", "Uma", "Victor", "Wesley", "Tom", "Susan", "Boris", "Kim", "Mary Ann", "John Paul"]
_PLACES = ["Paris", "Rome", "New York", "Oslo", "San Marino", "Lima"]


def _puzzle(r, text):
    names, places = [str(x) for x in r.permutation(_NAMES)], [str(x) for x in r.permutation(_PLACES)]
    numbers = [str(x) for x in r.permutation(np.arange(2, 60))[:3]]
    return text.format(**{f"n{i}": names[i] for i in range(5)}, **{f"p{i}": places[i] for i in range(2)}, a=numbers[0], b=numbers[1], c=numbers[2])


def test_decontamination_recall_of_other_values(spark):
    """Copies with other names, places and numbers, and with some names in small letters, inside other text; and texts that only look alike."""
    r = np.random.default_rng(21)
    filler = lambda n: " ".join(f"z{x}" for x in r.integers(0, 4000, n))
    items, docs, want = [], [], {}
    for i, text in enumerate(_PUZZLES):
        items.append((i, _puzzle(r, text)))
        for k in range(8):
            copy = _puzzle(r, text) if k < 5 else items[-1][1]
            if k >= 5:  # the item itself, with some of its capitals lost or a line broken before them
                copy = re.sub(r"\b[A-Z][a-z]+", lambda m: m[0].lower() if r.random() < 0.5 else m[0], copy) if k < 7 else copy.replace(", ", ",\n")
            want[len(docs)] = i
            docs.append((len(docs), f"{filler(20)}. {copy} {filler(20)}"))
    clean = ["Anna has 5 pens. Ben likes books. Cara gets up early and walks to the teacher every day of the week.", "A bus leaves late at 9 hours because the driver travels home first and then turns back to the city.",
             "In Paris the price of bread is a matter of state, while in Rome the bakers decide it among themselves.", "If Anna buys rice she pays in dollars, and the shop gives her a bag of the same size every week."]
    docs += [(1000 + i, f"{filler(20)} {t} {filler(20)}") for i, t in enumerate(clean)]
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert not {d for d, _ in got if d >= 1000}
    hit = [(d, i) in got for d, i in want.items()]
    assert np.mean(hit) >= 0.9, [docs[d] for (d, i), h in zip(want.items(), hit) if not h]
    assert got <= {(d, i) for d, i in want.items()}


def test_decontamination_of_awkward_rows(awkward, nothing, spark):
    items = spark.createDataFrame([(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (None, "x", "x"), (2, None, "x"), (3, "", "x"), (4, "same " * 40, "x")], "item_id long, text string, doc_id string")
    got = decontaminate.mark_contamination(awkward.unionByName(awkward), items).toPandas()
    assert len(got) == 2 * len(AWKWARD) and set(got[got.contaminated].doc_id) == {5, 6, 8}
    assert not decontaminate.mark_contamination(awkward, items.filter("item_id < 0")).filter("contaminated").count()
    assert decontaminate.mark_contamination(nothing, items).count() == 0


def test_contained_items_are_found(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    held = {d for d, t in zip(documents.doc_id, documents.text) if any(i in (t or "") for i in items.text)}
    got = run(spark, "op3_")
    assert held <= set(got[got.contaminated].doc_id) and len(got) == len(documents)


# --- 4 ---

def brute_lines(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        ls = t.split("\n")
        drop = set()
        for i in range(len(ls) - 2):
            w = tuple(x.strip(" ") for x in ls[i : i + 3])
            if "".join(w).strip(" "):
                if w in seen:
                    drop.update((i, i + 1, i + 2))
                seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(ls) if i not in drop), len(ls), len(drop))
    return out


def test_line_dedup(spark, documents):
    want = brute_lines([(d, t) for d, t in zip(documents.doc_id, documents.text) if t is not None])
    got = run(spark, "op4_")
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.itertuples()} == want
    assert got.n_removed.sum() > 0


def test_line_dedup_awkward(awkward, nothing):
    got = lines.dedup_lines(awkward).toPandas().set_index("doc_id")
    assert len(got) == len(AWKWARD) and got.loc[1].text is None and got.loc[7].text == "x\ny\nz" and got.loc[2].text == ""
    assert lines.dedup_lines(nothing).count() == 0


def brute_keyed_lines(rows):
    """Rows of (doc_id, text) whose texts under one doc_id differ, in order of their hash; repeated rows are one document."""
    import xxhash

    key = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    seen, gone = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0], key(r[1]))):
        ls = t.split("\n")
        for i in range(len(ls) - 2):
            w = tuple(x.strip(" ") for x in ls[i : i + 3])
            if "".join(w):
                if w in seen:
                    gone.setdefault((d, t), set()).update(range(i, i + 3))
                seen.add(w)
    return sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))) for d, t in rows)


def test_line_dedup_of_texts_under_one_id(spark):
    one, other = "\n".join(f"one {i}" for i in range(6)), "\n".join(f"other {i}" for i in range(6))
    rows = [(1, one), (5, one), (5, other), (5, other), (3, other + "\nend"), (7, f"start\n{one}\n{other}"), (7, "x\ny\nz"), (7, "x\ny\nz\nw")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute_keyed_lines(rows)
    assert [r.text for r in lines.dedup_lines(spark.createDataFrame([(1, one), (5, one), (5, other)], "doc_id long, text string")).orderBy("text").collect()] == ["", one, other]


# --- 5 ---

def test_passages_of_texts_under_one_id(spark):
    r = np.random.default_rng(11)
    text = lambda n: " ".join(f"v{x}" for x in r.integers(0, 9000, n))
    a, b = text(80), text(80)
    rows = [(5, a), (5, b), (3, b), (7, a), (5, a), (9, f"{text(20)} {a} {b}"), (9, b)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    shown = sorted((r.doc_id, r.n_words, r.n_dup_words, tuple(r.sources)) for r in got)
    # a stands first in 5, b in 3; of 9 the long text holds both.
    assert shown == [(3, 80, 0, ()), (5, 80, 0, ()), (5, 80, 0, ()), (5, 80, 80, (3,)), (7, 80, 80, (5,)), (9, 80, 80, (3,)), (9, 180, 160, (3, 5))]


def test_passages(spark):
    r = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    passage, other = word(90), word(70)
    near = passage.copy()
    near[40] = "changed"
    rows = [(1, word(100) + passage + word(40)), (2, word(30) + passage), (3, near + word(200)), (4, word(300)), (5, word(20) + other + word(20)),
            (6, word(50) + other + word(3) + passage[:60]), (7, word(10) + passage[:30] + word(50)), (8, word(49)), (9, [])]
    rows = [(d, " ".join(w)) for d, w in rows] + [(10, None), (11, " ".join(rows[3][1])), (12, "same " * 400), (13, "same " * 400)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert len(got) == 13
    spans = {d: [tuple(x) for x in s] for d, s in zip(got.index, got.spans)}
    assert spans[2] == [(30, 120)] and spans[11] == [(0, 300)] and spans[13] == [(0, 400)]
    assert len(spans[3]) == 1 and spans[3][0][0] == 0 and spans[3][0][1] == 90
    assert spans[6] == [(50, 120), (123, 183)]
    assert all(not spans[d] for d in (1, 4, 5, 7, 8, 9, 10, 12))
    assert list(got.loc[2].sources) == [1] and list(got.loc[11].sources) == [4]


@pytest.mark.parametrize("extra", [5, 6, 7])
@pytest.mark.parametrize("longer_first", [True, False])
def test_passages_with_inserted_words(spark, extra, longer_first):
    r = np.random.default_rng(extra)
    word = lambda n: [f"w{x}" for x in r.integers(0, 50000, n)]
    passage = word(80)
    longer = passage[:40] + word(extra) + passage[40:]
    one, two = (longer, passage) if longer_first else (passage, longer)
    a, b = (passages.shingle_hashes(" ".join(word(30) + x + word(30)), 5) for x in (one, two))
    assert passages._stretches(a, b, 46) == [(30, 30 + len(two) - 4)]
    rows = [(1, " ".join(one)), (2, " ".join(two))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert [tuple(x) for x in got.loc[2].spans] == [(0, len(two))] and not len(got.loc[1].spans)


def brute_passages(docs, n=50, size=5, percent=80):
    """The words of each document in a stretch of n words, shared at both ends, that is similar to n words of an earlier document."""
    cut = lambda w, i: tuple(w[i : i + size])
    sets = {d: [{cut(w, j) for j in range(i, i + n - size + 1)} for i in range(len(w) - n + 1)] for d, w in docs.items()}
    out = {d: set() for d in docs}
    for b in docs:
        for a in docs:
            if a < b:
                for i, x in enumerate(sets[b]):
                    ends = {cut(docs[b], i), cut(docs[b], i + n - size)}
                    if any(ends <= y and 100 * len(x & y) >= percent * len(x | y) for y in sets[a]):
                        out[b].update(range(i, i + n))
    return out


def test_passages_reach_every_holder(spark):
    r = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in r.integers(0, 90000, n)]
    docs = {}
    for family in range(6):
        base = word(60)
        # The first documents hold parts too short and a variant too far from the passage, those after it the passage and variants.
        docs[10 + family], docs[20 + family] = base[:35] + word(30), word(30) + base[25:]
        for k, changed in enumerate([(9, 29, 49), (), (), (15,), (22, 44), (40,), (5, 35)], 1):
            w = base.copy()
            for j in changed:
                w[j] = f"x{family}-{k}-{j}"
            docs[100 * k + family] = word(5 + 3 * k) + w + word(12 - k)
    got = passages.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")).toPandas().set_index("doc_id")
    held = {d: {i for x in got.spans[d] for i in range(*x)} for d in docs}
    want = brute_passages(docs)
    assert sum(map(len, want.values())) > 1000
    assert {d: sorted(want[d] - held[d]) for d in docs if want[d] - held[d]} == {}
    assert all(set(range(14, 74)) <= held[300 + f] and not held[200 + f] for f in range(6))


def test_hot_anchors_are_pruned_without_a_join_of_shingles(spark):
    r = np.random.default_rng(6)
    rows = [(int(key), d, int(p), r.choice([5, 40, 400, 1 << 31, 1 << 32][key], 91).astype(np.uint32)) for key in range(5) for d in range(12) for p in r.choice(900, 1 + d % 2, replace=False)]
    rows = [(key, d, p, (ctx if ctx.max() < 400 else ctx + np.uint32(d % 3))[: 91 - 7 * d]) for key, d, p, ctx in rows] + [(9, 1, 3, np.arange(91, dtype=np.uint32)), (9, 2, 5, np.arange(58, 150, dtype=np.uint32)[:91]), (9, 3, 5, np.arange(200, 291, dtype=np.uint32))]
    holders = Counter((key, s) for key, _, _, ctx in rows for s in set(ctx.tolist()))
    want = {(key, d, p) for key, d, p, ctx in rows if sum(holders[key, s] > 1 for s in ctx.tolist()) >= passages.ENOUGH}
    df = spark.createDataFrame([(key, d, p, d > 0, ctx.tobytes()) for key, d, p, ctx in rows], "key long, doc_id long, p long, open boolean, ctx binary")
    out = passages._common_enough(df)
    assert out.columns == df.columns and {(x.key, x.doc_id, x.p) for x in out.collect()} == want and 0 < len(want) < len(rows) and (9, 1, 3) in want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # of one row an anchor


def test_hot_anchors_make_no_rows_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(passages, "_common_enough", None)
    r = np.random.default_rng(14)
    word = lambda n: [f"w{x}" for x in r.integers(0, 90000, n)]
    line, passage = word(28), word(60)
    passage[16:44] = line
    near = passage.copy()
    near[50] = "other"
    docs = {d: word(30) + line + word(30) for d in range(1, 601)}
    docs |= {700: word(20) + passage + word(9), 701: word(40) + near, 704: word(9) + ["again"] * 80, 705: ["again"] * 60}
    got = passages.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert {d: [tuple(x) for x in got.spans[d]] for d in docs if len(got.spans[d])} == {701: [(40, 100)], 705: [(0, 60)]}
    assert list(got.sources[701]) == [700] and list(got.sources[705]) == [704]


def test_shingles_of_many_texts_at_once():
    r = np.random.default_rng(15)
    texts = [(" " * int(r.integers(1, 3))).join(r.choice(["a", "B", "\u00e9t\u00e9", "\u3000x", "b\nc", "\t"], int(n))) for n in [0, 1, 4, 5, 6, 900, 3, 40000, 2, 7]] + ["", "\n", "x" * 200_000, "end of it all now"]
    h, n = passages.shingles_of(texts)
    want = [passages.shingle_hashes(t, passages.SHINGLE) if len(t.encode().split()) >= passages.SHINGLE else np.empty(0, dtype=np.uint64) for t in texts]
    assert n.tolist() == [len(x) for x in want] and (h == np.concatenate(want)).all()
    assert [len(x) for x in passages.shingles_of([])] == [0, 0]


def test_least_is_a_bound_of_may_hold():
    r = np.random.default_rng(16)
    n, width = 4000, 91
    new = r.random((n, width)) < r.choice([0.1, 0.6, 1], (n, 1))
    shared = np.repeat(r.random((n, 13)) < r.choice([0.3, 0.7, 0.9], (n, 1)), 7, axis=1)
    size = r.integers(30, width + 1, n)
    inside = np.arange(width)[None, :] < size[:, None]
    new, shared = new & inside, shared & inside
    holds, least = passages._may_hold(shared, new, size), passages._least(new, size)
    assert 100 < holds.sum() < n - 100 and ((shared & new).sum(axis=1) >= least)[holds].all() and ((shared & new).sum(axis=1) < least).sum() > 100


def test_compact_windows_cover_each_subsequence_once():
    r = np.random.default_rng(0)
    for h in (r.integers(0, 1000, 60), r.integers(0, 3, 60), np.zeros(60, dtype=int)):
        spans = passages.compact_windows(h, 10)
        for i in range(60):
            for j in range(i + 9, 60):
                own = [s for s in spans if s[0] <= i <= s[1] <= j <= s[2]]
                assert len(own) == 1 and h[own[0][1]] == h[i : j + 1].min()


def test_passages_awkward(awkward, nothing):
    assert passages.repeated_passages(awkward).count() == len(AWKWARD)
    assert passages.repeated_passages(nothing).count() == 0


# --- 6 ---

def brute_url(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark):
    r = np.random.default_rng(2)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/b"]
    rules = {(hosts[i], paths[j]): ("allow", "block")[k] for i, j, k in zip(r.integers(0, 7, 16), r.integers(0, 7, 16), r.integers(0, 2, 16))}
    rules = [(*k, v) for k, v in rules.items()]
    made = [f"http://{'s.' * (i % 3)}{h}{p}{q}" for i, (h, p, q) in enumerate((h, p, q) for h in hosts for p in [*paths, "/a/b/c", "/abc"] for q in ("", "?x=/a", "#f"))]
    made += [None, "", "no scheme", "HTTP://A.COM/a/B", "x://y://a.com/a", "http://?a.com", "http://a.com:80/a", "http://a.com/a\n/b"] + ["http://a.com/a/b"] * 50
    pages = spark.createDataFrame([(i, u, "block", "x") for i, u in enumerate(made)], "page_id long, url string, verdict string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    got = urls.apply_url_rules(pages, table).toPandas().set_index("page_id")
    assert len(got) == len(made)
    for i, u in enumerate(made):
        x = got.loc[i]
        assert (x.host, x.path, x.rule, x.verdict) == brute_url(u, rules), u
    assert set(urls.apply_url_rules(pages, table.filter("host = 'none'")).toPandas().verdict) == {"allow"}
    assert urls.apply_url_rules(pages.filter("page_id < 0"), table).count() == 0


# --- 7 ---

def brute_components(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    part = {d: d for d in sets}
    ids = sorted(sets)

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def variants(n=160):
    r = np.random.default_rng(9)
    base, rows = [f"b{i}" for i in range(120)], []
    for d in range(n):
        w = base.copy()
        for j in r.integers(0, 120, r.integers(0, 9)):
            w[j] = f"e{r.integers(0, 99)}"
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, documents, size, percent):
    rows = list(zip(documents.doc_id.tolist(), documents.text)) + [(d + 10**6, t) for d, t in variants()] + [(d + 2 * 10**6, t) for d, t in AWKWARD]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_components(rows, size, percent)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_near_duplicates_awkward(awkward, nothing, spark):
    twice = awkward.unionByName(awkward)
    got = neardup.near_duplicates(twice).toPandas()
    assert len(got) == 2 * len(AWKWARD) and got.set_index("doc_id").loc[6].component_id.tolist() == [5, 5]
    assert neardup.near_duplicates(nothing).count() == 0
    null = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert neardup.near_duplicates(null).filter("kept").count() == 2


def test_scratch_goes_early(spark, tmp_path, monkeypatch):
    """A written table leaves no shuffle files behind, rounds of components no earlier round."""
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    counts = common.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not shuffles() - before and counts.count() == 7
    common.discard(counts)
    monkeypatch.setattr(common, "shared_dir", lambda _: tmp_path.as_uri())
    path = connected_components(spark.range(1, 40).selectExpr("id - 1 AS u", "id AS v"))
    assert {r.component for r in path.collect()} == {0}
    assert len(list((tmp_path / "marketloom").iterdir())) == 1


def test_near_duplicates_leaves_its_result_alone(spark, documents, tmp_path, monkeypatch):
    """Sketches, texts, buckets, pairs and links go before the result is read; nothing of them is read again."""
    monkeypatch.setattr(common, "shared_dir", lambda _: tmp_path.as_uri())
    got = neardup.near_duplicates(spark.createDataFrame(documents[["doc_id", "text"]].head(60), "doc_id long, text string"))
    assert [p.name.partition("-")[0] for p in (tmp_path / "marketloom").iterdir()] == ["near_duplicates"]
    assert got.count() == 60


def test_components_by_few_exchanges(spark, monkeypatch):
    """A round of the stars deals rows out four times; a task for each of many partitions costs log and files each time."""
    from marketloom.llm import components

    plans = []
    monkeypatch.setattr(components, "materialise", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), common.materialise(df, name))[1])
    edges = [(i, j) for i in range(30) for j in (i + 1, 2 * i + 3, 0)] * 2
    named = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.component for r in named.collect()} == {0} and sorted(r.node for r in named.collect()) == sorted({x for e in edges for x in e})
    stars = [p for n, p in plans if n == "stars"]
    assert sum(p.count("Exchange") for p in stars[2:4]) <= 4


def test_near_duplicates_of_texts_under_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (3, b), (7, a + " more"), (5, a), (9, None), (9, b + " more"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicate_rows(docs).collect()
    assert len(got) == len(rows)
    shown = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert shown == [(3, 56, 3, True), (5, 56, 3, False), (5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False), (9, 0, 9, True), (9, 0, 9, True), (9, 57, 3, False)]
    import corpus_pipeline

    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(3, b), (5, a), (5, a), (9, ""), (9, "")])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (300, 302), (301, 302), (303, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200} | {300: 300, 301: 300, 302: 300, 303: 300}


# --- 8 ---

def test_shards(spark, documents):
    got = run(spark, "op8_")
    check_shards(got, documents)


def check_shards(got, documents, tolerance=0.01):
    want = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in zip(documents.doc_id, documents.text)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert got.shard.between(0, 7).all() and np.abs(sums - got["size"].sum() / 8).max() <= max(got["size"].max(), tolerance * sums.mean())


def test_shards_with_a_hot_text(spark):
    docs = pd.DataFrame({"doc_id": range(4000), "text": ["hot text " * 5 if i % 3 else f"text {i} " * (i % 9) for i in range(4000)]})
    got = sharding.histogram_shards(spark.createDataFrame(docs), 8).toPandas()
    check_shards(got, docs)
    assert got.merge(docs, on="doc_id").groupby("text").shard.nunique().value_counts().get(1) >= docs.text.nunique() - 8


def test_shards_awkward(awkward, nothing):
    got = sharding.histogram_shards(awkward.unionByName(awkward), 8).toPandas()
    assert len(got) == 2 * len(AWKWARD)
    whole = sharding.shard_documents(awkward, 8).toPandas()
    assert set(awkward.columns) <= set(whole.columns) and whole.set_index("doc_id").text[4] == "one"
    assert sharding.histogram_shards(nothing, 8).count() == 0


def test_shards_carry_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None if i % 4 == 0 else i, f"t{i % 7}", i, "x") for i in range(300)], "doc_id long, text string, size long, slot string")
    got = sharding.shard_documents(docs, 8, parts_per_shard=5).toPandas()
    assert len(got) == 300 and got.doc_id.isna().sum() == 75 and (got["size"] == 3).all()
    assert (got.groupby("shard").slot.apply(sorted).apply(lambda x: x == list(range(len(x))))).all()
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all()


# --- 9 ---

def test_languages(spark, documents):
    got = run(spark, "op9_").set_index("doc_id")
    docs = documents.set_index("doc_id")
    held = got[got.held_out].index
    assert set(held) == {d for d in docs.index if zlib.crc32(str(d).encode()) % 5 == 0}
    letters = [d for d in held if any(c.isalpha() for c in docs.text[d] or "") and docs.lang[d] is not None]
    assert np.mean([got.lang_pred[d] == docs.lang[d] for d in letters]) >= 0.95
    assert got.score.between(0, 1).all()


def test_languages_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "the same text here", "en"), (None, "the same text here", "en"), (3, "la misma cosa aqu\u00ed", "es"), (3, "la misma cosa aqu\u00ed", "es")], "doc_id long, text string, lang string")
    got = language.identify_languages(docs).toPandas()
    assert len(got) == 4 and got.doc_id.isna().sum() == 2 and not got.held_out[got.doc_id.isna()].any()
    model = language.train_language_model(docs, language.F.lit(True))
    kept = language.known_languages(docs.withColumn("_x", language.F.array("lang")), model)
    assert kept.columns == ["doc_id", "text", "lang", "_x"] and kept.count() <= 4


def test_languages_awkward(awkward, nothing):
    got = language.identify_languages(awkward).toPandas().set_index("doc_id")
    assert len(got) == len(AWKWARD) and (got.lang_pred[[1, 2, 3]] == "und").all() and (got.score[[1, 2, 3]] == 0).all()
    assert language.identify_languages(nothing).count() == 0


# --- 10 ---

def check_packing(got, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert not got.duplicated(["sequence_id", "offset"]).any()
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, x in zip(docs.doc_id, docs.text)}
    for d, pieces in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    assert set(got.doc_id) == set(ids)
    filled = []
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all()
        filled.append(int(s.length.sum()))
    assert max(filled) <= 4096 and sum(f < 4096 for f in filled) <= 1


def test_packing(spark, documents):
    check_packing(run(spark, "op10_"), documents)


def test_packing_awkward(awkward, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack(awkward, path).toPandas(), pd.DataFrame(AWKWARD, columns=["doc_id", "text"]))
    assert packing.pack(nothing, path).count() == 0


def test_hilbert_neighbours_touch():
    n = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << n)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(cells, n)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


# --- 11 ---

def vector_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<double>, label int, cluster int, q string").repartition(3)


def brute_clusters(rows, dim, k, rounds, scale=256):
    """vec_id, cluster, distance of each kept row, in plain integers."""
    import hashlib
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [q for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(now)) for _, q in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(now)):
            held = [q for (_, q), (_, c) in zip(kept, own) if c == j]
            if held:
                now[j] = [sum(x) // len(held) for x in zip(*held)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, assign())]


def test_centroids_of_awkward_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(-3, 4, 8) / 4.0).tolist(), 0) for i in range(120)]  # many ties
    rows += [(i, rows[3][1], 0) for i in range(200, 260)]  # copies
    rows += [(7, [9.0] * 8, 0), (7, [-9.0] * 8, 0), (None, [0.5] * 8, 0), (300, None, 0), (301, [1.0] * 7, 0), (302, [], 0), (303, [float("nan")] + [0.0] * 7, 0),
             (304, [float("inf")] + [0.0] * 7, 0), (305, [None] + [0.0] * 7, 0), (306, [-0.001] * 8, None)]
    got = centroids.cluster_vectors(vector_rows(spark, rows), dim=8, k=12, rounds=5, leading=3).toPandas()
    key = lambda x: (x[0] is None or x[0] != x[0], *map(float, x[1:]), 0 if x[0] is None or x[0] != x[0] else x[0])
    mine = sorted(((None if x.vec_id != x.vec_id else int(x.vec_id), x.cluster, x.distance) for x in got.itertuples()), key=key)
    assert mine == sorted(brute_clusters(rows, 8, 12, 5), key=key)
    assert (got.inertia == got.distance.sum()).all() and (got.cluster_inertia == got.groupby("cluster").distance.transform("sum")).all()


def test_few_and_no_vectors(spark):
    rows = vector_rows(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.5], 0)])
    assert centroids.cluster_vectors(rows, dim=2).count() == 2
    assert centroids.cluster_vectors(rows.filter("vec_id < 0"), dim=2).count() == 0
    with pytest.raises(Exception, match="ArithmeticError"):
        centroids.cluster_vectors(vector_rows(spark, [(1, [1e300, 2.0], 0)]), dim=2).count()


def test_bounds_leave_few_centroids():
    r = np.random.default_rng(3)
    middle = r.normal(0, 200, (40, 64))
    q = np.floor(middle[r.integers(0, 40, 2000)] + r.normal(0, 20, (2000, 64))).astype(np.int64)
    now = np.floor(middle).astype(np.int64)
    mean, axes = centroids.rotation(len(q), q.sum(axis=0).astype(float), (q.T @ q).astype(float))
    chosen, least, n = centroids.nearest(q, *centroids.rotated(q, mean, axes, 16), now, *centroids.rotated(now, mean, axes, 16))
    d = ((q[:, None, :] - now[None]) ** 2).sum(axis=2)
    assert (chosen == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all() and n < 3 * len(q)


# --- 12 ---

def brute_fingerprint(text):
    import xxhash

    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(ids, marks, near=4):
    """The least id of each row's component."""
    part = list(range(len(ids)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    x = np.array(marks, dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= near) + i + 1:
            part[top(j)] = top(i)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    return [min((d for d in groups[top(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash(spark, documents):
    got = run(spark, "op12_").set_index("doc_id")
    marks = [brute_fingerprint(t) for t in documents.text]
    assert got.loc[documents.doc_id].fingerprint.tolist() == [f"{x:016x}" for x in marks]
    assert got.loc[documents.doc_id].component_id.tolist() == brute_near(documents.doc_id.tolist(), marks)


def test_simhash_awkward(awkward, nothing, spark):
    got = simhash.simhash_duplicates(awkward).toPandas().set_index("doc_id")
    marks = [brute_fingerprint(t) for _, t in AWKWARD]
    assert got.loc[[i for i, _ in AWKWARD]].fingerprint.tolist() == [f"{x:016x}" for x in marks]
    assert got.loc[[i for i, _ in AWKWARD]].component_id.tolist() == brute_near([i for i, _ in AWKWARD], marks)
    assert simhash.simhash_duplicates(nothing).count() == 0
    rows = [(5, "a b c d e f"), (5, "other words of this row"), (3, "other words of this row"), (7, "a b c d e f"), (None, "alone in the world here"), (None, "a b c d e f"), (5, "a b c d e f")]
    got = simhash.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = list(zip(*zip(*rows), brute_near([d for d, _ in rows], [brute_fingerprint(t) for _, t in rows])))
    plain = lambda x: None if x is None or x != x else int(x)
    key = lambda x: (x[1], -1 if x[0] is None else x[0])
    assert sorted(((plain(x.doc_id), x.fingerprint, plain(x.component_id)) for x in got.itertuples()), key=key) == sorted(((d, f"{brute_fingerprint(t):016x}", c) for d, t, c in want), key=key)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"W{i % 97} x{i}" for i in range(3000)) + "\u00c9 \u0130\ud800"
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 50)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("a b") == brute_fingerprint("a b")


def near_marks(n, seed=4):
    """Patterns in groups that chain, cross every part of the bits and fall into few nodes."""
    r = np.random.default_rng(seed)
    out = [0, 1, (1 << 64) - 1]
    heads = r.integers(0, 1 << 63, 8, dtype=np.uint64).tolist()
    for h in heads:
        x = h
        for _ in range(n // 16):
            for b in r.choice(64, r.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x)
        out += [h ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (n // 16, 2))]
    return sorted(set(out))


@pytest.mark.parametrize("size", [4, 1024])
def test_fingerprint_links_reach_all(spark, size):
    marks = near_marks(1200)
    signed = np.array(marks, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5), 4, size)
    assert links.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 64).count() == 0
    named = dict(connected_components(links).collect())
    got = [named.get(x, x) for x in signed]
    want = brute_near(signed, marks)
    assert got == want


def test_near_pairs_against_all_pairs():
    marks = np.array(near_marks(400), dtype=np.uint64)
    marks = marks[np.argsort(simhash.gray_rank(marks))]
    node = np.sort(np.random.default_rng(2).integers(0, 4, len(marks)))
    i, j = simhash.near_pairs(marks, node, 4)
    d = np.bitwise_count(marks[:, None] ^ marks[None, :])
    want = np.argwhere((d <= 4) & (node[:, None] == node[None, :]) & (np.arange(len(marks))[:, None] < np.arange(len(marks))[None, :]))
    assert len(want) > 100 and sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


# --- 13 ---

def brute_negatives(rows, ask, n_pos=5, n_neg=10):
    import math

    kept = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a in ask:
        if a not in whole:
            continue
        label, q = whole[a]
        s = sorted((-sum(x * y for x, y in zip(q, v)), i, k) for i, (k, v) in whole.items() if i != a)
        for p, i, _ in [x for x in s if x[2] == label][:n_pos]:
            fit = [x for x in s if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:n_neg]
            out += [(a, i, r, j, -p, -n) for r, (n, j, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_of_awkward_rows(spark):
    r = np.random.default_rng(8)
    rows = [(i, (r.integers(-2, 3, 6) / 8.0).tolist(), int(r.integers(0, 3))) for i in range(150)]  # many equal scores
    rows += [(i, rows[5][1], 1) for i in range(400, 460)] + [(20, [0.5] * 6, 0), (20, [0.25] * 6, 0)]
    rows += [(500, None, 1), (501, [1.0] * 6, None), (502, [None] * 6, 1), (503, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (504, [1.0, -1.0], 2), (505, [], 2), (506, [0.5] * 9, 1)]
    ask = [0, 20, 40, 60, 401, 500, 504, 506, 999]
    table = vector_rows(spark, rows)
    got = negatives.hard_negatives(table, spark.createDataFrame([(i,) for i in ask], "vec_id long")).toPandas()
    want = brute_negatives(rows, ask)
    assert len(want) > 100 and sorted(map(tuple, got.itertuples(index=False))) == want
    assert negatives.hard_negatives(table.filter("vec_id < 0"), table.select("vec_id")).count() == 0


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (64, 64, 64), (65, 70, 129), (33, 0, 40), (200, 64, 90)])
def test_strassen(m, k, n):
    r = np.random.default_rng(m)
    a, c = r.integers(-10 ** 6, 10 ** 6, (m, k)), r.integers(-10 ** 6, 10 ** 6, (n, k))
    assert (negatives.strassen(a, c) == a @ c.T).all()


def test_best_takes_the_leftmost_of_equals():
    s = np.array([[5, 7, 7, 7, 1], [1, 1, 1, 1, 1], [3, 2, 1, 0, 9]])
    fits = np.array([[True, True, True, True, True], [False, True, True, False, True], [False, False, False, False, True]])
    i, j = negatives.best(s, fits, 2)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 4)]


# --- SQL twins ---

@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()
    key = ["anchor_id", "positive_id", "rank"] if "anchor_id" in got else got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True).astype(object).where(lambda d: d.notna(), None) for x in (got[sorted(got)], want[sorted(got)]))
    assert got.values.tolist() == want.values.tolist()
