"""What is asked of features, labels and scores before and after a model is trained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.ranking import average_rank
from marketloom.panel import div, lag


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, dtype, nulls, total, n_distinct), one pass; the distinct counts are exact."""
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("_total")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"_n{i}"), F.count_distinct(c).alias(f"_d{i}")]
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("dtype"), (F.col("_total") - F.col(f"_n{i}")).alias("nulls"), F.col("_total").alias("total"), F.col(f"_d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def feature_sketch(df: DataFrame, columns: list[str], quantiles: list[float] = [0.25, 0.5, 0.75], rsd: float = 0.02, accuracy: int = 10000) -> DataFrame:
    """(feature, dtype, nulls, total, n_distinct, quantiles) from sketches that merge, so tasks send a few kilobytes a column.

    n_distinct is off by about rsd (one deviation); a quantile's rank is off by 2 * total / accuracy at most. Quantiles are given of
    numbers and dates (as days since 1970), in the order asked; null for other kinds and for columns without a value. feature_summary
    counts exactly, at the price of a row for each column and value.
    """
    kinds = dict(df.dtypes)
    share = F.lit(quantiles).cast("array<double>")
    aggs = [F.count("*").alias("_total")]
    for i, c in enumerate(columns):
        x = F.unix_date(c) if kinds[c] == "date" else F.col(c)
        ordered = kinds[c] in ("date", "tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        points = F.percentile_approx(x.cast("double"), share, accuracy) if ordered else F.lit(None).cast("array<double>")
        aggs += [F.count(c).alias(f"_n{i}"), F.approx_count_distinct(c, rsd).alias(f"_d{i}"), points.alias(f"_q{i}")]
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("dtype"), (F.col("_total") - F.col(f"_n{i}")).alias("nulls"), F.col("_total").alias("total"), F.col(f"_d{i}").alias("n_distinct"),
                      F.col(f"_q{i}").alias("quantiles")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def limit_filter(df: DataFrame, buffer: float = 0.001, overrides: DataFrame | None = None) -> DataFrame:
    """Drop rows whose move reaches the daily price limit: 20 % for symbols 300, 301 and 688, 5 % for ST names, else 10 %.

    overrides: (symbol, limit), joined by symbol. A symbol's first row stays.
    """
    limit = F.when(F.col("symbol").rlike("^(300|301|688)"), 0.20)
    if "name" in df.columns:
        limit = limit.when(F.upper("name").contains("ST"), 0.05)
    limit = limit.otherwise(0.10)
    if overrides is not None:
        df = df.join(overrides.select("symbol", F.col("limit").alias("_own")), "symbol", "left")
        limit = F.coalesce(F.col("_own"), limit)
    move = F.abs(div(F.col("Close"), lag("Close")) - 1)
    return df.withColumns({"_move": move, "_limit": limit}).filter(F.col("_move").isNull() | (F.col("_move") < F.col("_limit") - buffer)).select(*[c for c in df.columns if c != "_own"])


def align_xy(x: DataFrame, y: DataFrame, features: list[str], dropna: bool = True) -> DataFrame:
    """Features and label of the (symbol, Date) that have both; with dropna only rows without a null feature."""
    out = x.select("symbol", "Date", *features).join(y.select("symbol", "Date", "label").filter("label is not null"), ["symbol", "Date"])
    return out.dropna(subset=features) if dropna else out


def diagnose_pool(raw: DataFrame, aligned: DataFrame, symbols: DataFrame, min_history: int = 100, train_window: int = 80) -> DataFrame:
    """(symbol, raw_rows, aligned_rows, reason) for every symbol of a pool: why it can be trained on, or not."""
    counts = [df.groupBy("symbol").agg(F.count("*").alias(c)) for df, c in ((raw, "raw_rows"), (aligned, "_aligned"))]
    out = symbols.select("symbol").distinct().join(counts[0], "symbol", "left").join(counts[1], "symbol", "left").withColumn("raw_rows", F.coalesce("raw_rows", F.lit(0).cast("long")))
    rows = F.when(F.col("raw_rows") < min_history, 0).otherwise(F.coalesce("_aligned", F.lit(0))).cast("long")
    a = F.col("aligned_rows")
    reason = (F.when(F.col("raw_rows") == 0, "empty").when(F.col("raw_rows") < min_history, f"raw rows < min_history({min_history})")
              .when(a == 0, "no rows after features+align").when(a < train_window, f"aligned rows < train_window({train_window})").otherwise("ok"))
    return out.withColumn("aligned_rows", rows).select("symbol", "raw_rows", "aligned_rows", reason.alias("reason"))


#: Value ranges into which a whole column is cut to number its values.
RANGES = 64


def value_places(df: DataFrame, c: str) -> DataFrame:
    """(value, n, before): each distinct non-null value, its rows and the rows with smaller values, over the whole table.

    Rows are counted by value first. Approximate quantiles of the values (RANGES numbers) cut them into ranges; each range is
    numbered in a window of its own and moved by the rows of the ranges before it.
    """
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 1000).alias("q")).first()["q"] or []
    cut = F.lit(0)
    for q in sorted(set(cuts)):
        cut = cut + F.when(F.col("value") > q, 1).otherwise(0)
    ranged = counts.withColumn("_range", cut)
    totals = ranged.groupBy("_range").agg(F.sum("n").alias("_sum"))
    offsets = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").select("value", "n", (F.col("_offset") + F.col("_inside")).alias("before"))


def ic_pooled(df: DataFrame, pred: str, true: str, method: str = "spearman") -> DataFrame:
    """One row (n, ic): correlation over all rows together; null for fewer than two rows or a constant column."""
    kept = df.select(F.col(pred).alias("_p"), F.col(true).alias("_t")).dropna()
    if method == "spearman":
        for c in ("_p", "_t"):
            ranks = value_places(kept, c).select(F.col("value").alias(c), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"_r{c}"))
            kept = kept.join(ranks, c)
        kept = kept.select(F.col("_r_p").alias("_p"), F.col("_r_t").alias("_t"))
    varied = (F.min("_p") < F.max("_p")) & (F.min("_t") < F.max("_t")) & (F.count("*") >= 2)
    return kept.agg(F.count("*").alias("n"), F.when(varied, F.corr("_p", "_t")).alias("ic"))


def layered(df: DataFrame, pred: str, true: str, n: int = 5) -> DataFrame:
    """(layer, n, mean, std) of the returns in n score buckets cut at linear quantiles over all rows; equal edges fall together."""
    kept = df.select(F.col(pred).alias("_p"), F.col(true).alias("_t")).dropna()
    places = value_places(kept, "_p")
    total = kept.count()
    if not total:
        return kept.select(F.lit(1).alias("layer"), F.lit(0).cast("long").alias("n"), F.col("_t").alias("mean"), F.col("_t").alias("std"))
    wanted = [(k, (total - 1) * k / n) for k in range(1, n)]
    at = lambda i: F.max(F.when((F.col("before") <= i) & (F.col("before") + F.col("n") > i), F.col("value")))
    got = places.agg(F.min("value").alias("least"), *[at(int(h) + d).alias(f"e{k}_{d}") for k, h in wanted for d in (0, 1)]).first()
    edges = {got[f"e{k}_0"] + ((got[f"e{k}_1"] or 0) - got[f"e{k}_0"]) * (h - int(h)) if h > int(h) else got[f"e{k}_0"] for k, h in wanted}
    layer = F.lit(1)
    for e in sorted(e for e in edges if e > got["least"]):
        layer = layer + F.when(F.col("_p") > e, 1).otherwise(0)
    return kept.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.avg("_t").alias("mean"), F.stddev_samp("_t").alias("std"))


def signal_win_rate(df: DataFrame, signal: str = "signal", ret: str = "fwd_ret") -> DataFrame:
    """(signal, n, hits, hit_rate): buys followed by a gain, sells followed by a loss."""
    hit = ((F.col(signal) == "b") & (F.col(ret) > 0)) | ((F.col(signal) == "s") & (F.col(ret) < 0))
    out = df.filter(F.col(signal).isin("b", "s") & F.col(ret).isNotNull()).groupBy(F.col(signal).alias("signal")).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("n"))


def score_comparison(df: DataFrame, a: str, b: str, true: str) -> DataFrame:
    """One row: pooled rank IC of two scores and of their 50/50 blend of percent ranks by date (12 digits, so that equal
    blends tie), with the differences."""
    kept = df.select("Date", F.col(a).alias("a"), F.col(b).alias("b"), F.col(true).alias("t")).dropna()
    size = F.count("*").over(Window.partitionBy("Date"))
    blend = 0.5 * average_rank("a", ["Date"]) / size + 0.5 * average_rank("b", ["Date"]) / size
    kept = kept.withColumn("blend", F.round(blend, 12))
    out = None
    for c in ("a", "b", "blend"):
        one = ic_pooled(kept, c, "t").select(F.col("ic").alias(f"ic_{c}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.withColumns({"a_minus_b": F.col("ic_a") - F.col("ic_b"), "blend_minus_a": F.col("ic_blend") - F.col("ic_a")})
