"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of templates join by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise

#: Unit words that become one typed slot after a number.
UNITS = "mm cm m km mg g kg t ml l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles inch inches foot feet pound pounds dollar dollars euro euros cent cents percent degree degrees".split()
#: Words of a window, and how many windows at one distance mark a document (an item with fewer windows must match whole).
WINDOW, RUN = 8, 3
#: Benchmark windows up to this number are broadcast (24 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000


#: What separates words.
_GAPS = r"[\x00\x03-\x2f:;<=>?@\[\]\\^_`{|}~\u00a0\u00ab\u00bb\u00bf\u00a1\u2013\u2014\u2018\u2019\u201c\u201d]+"


def _tokens(docs: DataFrame, id_col: str) -> DataFrame:
    """id, raw: the words of a text, as an array of the row; names and units carry a leading mark.

    Whole-text passes mark what a split would lose: a name is a word of a capital and a small letter or more, wherever it stands;
    names that follow each other after one blank are one; a unit follows a number. Inner . and , of numbers go, so that a number is
    one word.
    """
    marked = F.regexp_replace(F.regexp_replace("text", r"(?<![\p{L}\p{N}])(?=\p{Lu}\p{Ll})", "\x01"), "(?<=\\p{L}) \x01(?<=\x01[\\p{L}'\u2019]{2,40} \x01)", "\x01")
    counted = F.regexp_replace(F.regexp_replace("m", rf"(?<=\d)[ -]?(?=(?:{'|'.join(UNITS)})\b)", " \x02"), r"(?<=\d)[.,](?=\d)", "")
    docs = docs.select(id_col, marked.alias("m"))
    marked = F.when(F.col("m").rlike(r"\d"), counted).otherwise(F.col("m"))
    return docs.select(F.col(id_col).alias("id"), F.filter(F.split(marked, _GAPS), lambda x: x != "").alias("raw"))


def _words(raw: str) -> Column:
    return F.transform(raw, lambda x: F.lower(F.ltrim(x, F.lit("\x01\x02"))))


def _templates(raw: str) -> Column:
    """# for a word that begins with a digit, @ for a name, % for a unit, else the lower-cased word."""
    first = lambda x: F.substring(x, 1, 1)
    return F.transform(raw, lambda x: F.when(x >= "A", F.lower(x)).when(first(x) == "\x01", "@").when(first(x) == "\x02", "%").when(x < ":", "#").otherwise(F.lower(x)))


def _spans(k: str, n: int) -> Column:
    """Hashes of all windows of n templates of the array k of template hashes, by position; none if it is shorter."""
    at = F.sequence(F.lit(1), F.size(k) - (n - 1))
    return F.when(F.size(k) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(k, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def _variants(k: Column, w: Column) -> Column:
    """Windows of templates k in which each name of one word stands as @ or as the word of w, in every combination (2 ** WINDOW at most)."""
    spots = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: (F.get(k, i) == "@") & ~F.get(w, i).contains("\x01"))

    def one(mask: Column) -> Column:
        bit = lambda i: F.getbit(mask, (F.array_position(spots, i) - 1).cast("int"))
        return F.transform(k, lambda x, i: F.when(F.array_contains(spots, i), F.when(bit(i) == 1, F.get(w, i)).otherwise(x)).otherwise(x))

    masks = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size(spots)).cast("long") - 1)
    return F.transform(masks, one)


def _windows(hashed: DataFrame, lengths: list[int], *keep) -> DataFrame:
    """pos and h of the windows of each of the lengths."""
    each = [hashed.select(*keep, F.posexplode(_spans("kh", n)).alias("pos", "h"), F.lit(n).alias("n")) for n in lengths]
    return reduce(DataFrame.unionByName, each)


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, verbatim): which documents hold a benchmark passage, also with other values.

    Windows of WINDOW templates of documents and items join by hash. Matches of one document and item at one distance between
    positions form a chain; a chain counts with RUN windows, or all but one of an item that has no more. Slots are checked on the
    chain's windows, not in the gaps between them: each slot value of the item must always stand for one and the same value of the
    document, and for no two values of one type the same, so a question with changed numbers and names is caught and an
    accidental template is not. Windows with the same words count without that check; a chain whose slots differ counts by these
    alone (and n_windows is their number). Items shorter than WINDOW match as one window of their own length. A window of slots
    alone never counts. A name of the item also matches its own word in small letters, in every combination (2 ** WINDOW rows of a
    window at most, on the item's side); names of several words do so where the whole copy is in small letters or in capitals.

    Null and empty texts hold nothing; repeated rows count once; an empty benchmark finds nothing. Rows whose id is null
    are left out. Other columns are not looked at.
    """
    own_docs, own_items = docs.select(doc_id, "text").filter(F.col(doc_id).isNotNull()), benchmark.select(item_id, "text").filter(F.col(item_id).isNotNull())
    hashes = F.transform("k", lambda x: F.xxhash64(x))
    own_items = own_items.filter("text is not null").dropDuplicates([item_id])
    forms = [_tokens(own_items.withColumn("text", form("text")), item_id).filter(F.size("raw") > 0).select("id", F.lit(i).alias("form"), _words("raw").alias("w"), _templates("raw").alias("k"))
             for i, form in enumerate((F.col, F.lower, F.upper))]
    # Forms with the same templates are one.
    items = reduce(DataFrame.unionByName, forms).groupBy("id", "k").agg(F.min(F.struct("form", "w")).alias("x")).select("id", "x.form", "x.w", "k")
    items = materialise(items, "items")
    plain = lambda c: F.size(F.filter(c, lambda x: ~x.isin("#", "@", "%")))
    lengths = sorted(r.n for r in items.select(F.least(F.size("k"), F.lit(WINDOW)).alias("n")).distinct().collect()) or [WINDOW]  # at most WINDOW numbers
    at = F.explode(F.sequence(F.lit(0), F.size("k") - F.col("n"))).alias("item_pos")
    each = items.select("id", "form", "k", "w", F.least(F.size("k"), F.lit(WINDOW)).alias("n")).select("id", "form", "n", "k", "w", at)
    window = lambda c: F.slice(c, F.col("item_pos") + 1, F.col("n"))
    each = each.select("id", "form", "item_pos", "n", window("k").alias("k"), window("w").alias("w")).withColumn("k", F.explode(_variants(F.col("k"), F.col("w"))))
    item_windows = each.filter(plain("k") > 0).select(F.col("id").alias("item"), "form", "item_pos", F.xxhash64(F.transform("k", lambda x: F.xxhash64(x))).alias("h"), "n").distinct()
    item_windows = materialise(item_windows, "item_windows")
    n_windows = item_windows.count()
    tokens = _tokens(own_docs.filter("text is not null"), doc_id)
    at = _windows(tokens.select("id", _templates("raw").alias("k")).select("id", hashes.alias("kh")), lengths, "id").drop("n")
    small = F.broadcast(item_windows) if n_windows <= BROADCAST_WINDOWS else item_windows
    hits = at.join(small, "h").select("id", "item", "form", "item_pos", "pos", "n", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = materialise(hits.distinct(), "template_hits")

    of_item = item_windows.groupBy("item", "form").agg(F.count_distinct("item_pos").alias("n_item"))
    chains = (hits.groupBy("id", "item", "form", "shift").agg(F.count("*").alias("n_windows"), F.array_sort(F.collect_set("item_pos")).alias("at"), F.first("n").alias("n"))
              .join(of_item, ["item", "form"]).withColumn("need", F.least(F.lit(RUN), F.greatest(F.col("n_item") - 1, F.lit(1)))).filter("n_windows >= need"))
    # Words of both sides, for the few documents that are left; slots must be replaced one for one.
    held_docs = own_docs.join(chains.select(F.col("id").alias(doc_id)).distinct(), doc_id, "left_semi")
    words = _tokens(held_docs, doc_id).select("id", _words("raw").alias("doc_w"))
    sides = chains.join(words, "id").join(items.select(F.col("id").alias("item"), "form", F.col("w").alias("item_w"), F.col("k").alias("item_k")), ["item", "form"])
    span = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("n") - 1))))
    same = F.filter("at", lambda p: F.slice("item_w", p + 1, F.col("n")) == F.slice("doc_w", p + F.col("shift") + 1, F.col("n")))
    slots = F.filter(F.transform(span, lambda i: F.struct(F.get("item_k", i).alias("type"), F.get("item_w", i).alias("a"), F.get("doc_w", i + F.col("shift")).alias("b"))), lambda s: s["type"].isin("#", "@", "%"))
    sides = sides.withColumns({"slots": F.array_distinct(slots), "n_same": F.size(same).cast("long")})
    types = lambda f: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["type"], s[f]))))
    sides = sides.withColumn("one_for_one", (types("a") == F.size("slots")) & (types("b") == F.size("slots")))
    consistent = sides.filter("one_for_one or n_same >= need").withColumn("n_windows", F.when(F.col("one_for_one"), F.col("n_windows")).otherwise(F.col("n_same")))
    return (consistent.groupBy("id", "item").agg(F.max("n_windows").alias("n_windows"), F.max(F.size("slots")).alias("n_slots"), F.max(F.forall("slots", lambda s: s["a"] == s["b"])).alias("verbatim"))
            .select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_slots", "verbatim"))


def mark_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, n_windows, contaminated: one row for each row given; documents that hold nothing count 0."""
    found = find_contamination(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("n_windows").alias("n_windows"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.col("n_items").isNotNull().alias("contaminated"))
