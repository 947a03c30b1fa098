"""Stored bars and what arrives for them: files, vendor rows, corporate actions, snapshots, symbols, pools and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.panel import dedupe, div

BARS = "Date date, Open double, High double, Low double, Close double, AdjClose double, Volume double, Dividend double, Split double"
KEY = ["symbol", "Date"]


def load_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars of a folder that save_bars wrote, or of CSV files with a header: one a symbol, <symbol>.csv or in symbol=<symbol>/.

    Symbols of a saved folder are directories, so a filter on symbol reads that symbol's files alone. Small files share tasks:
    Spark packs them up to spark.sql.files.maxPartitionBytes.
    """
    order = [c.split()[0] for c in BARS.split(", ")]
    if fmt == "parquet":
        return spark.read.schema(f"{BARS}, symbol string").parquet(path).select("symbol", *order)
    # The schema names the columns of the files alone; the path says the symbol in either layout.
    rows = spark.read.schema(BARS).option("recursiveFileLookup", True).csv(path, header=True, enforceSchema=False)
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    part = lambda pattern: F.nullif(F.regexp_extract(F.input_file_name(), pattern, 1), F.lit(""))
    # Names of files come encoded; names of folders were encoded when they were written too.
    symbol = F.coalesce(plain(plain(part(r"symbol=([^/]+)/[^/]*$"))), plain(part(r"([^/]+)\.csv$")))
    return rows.select(symbol.alias("symbol"), *order)


def save_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write bars by symbol, sorted by Date; a symbol's rows meet in one task, as its file needs. fmt csv writes headers too."""
    rows = bars.select("symbol", *[c.split()[0] for c in BARS.split(", ")]).repartition("symbol").sortWithinPartitions("symbol", "Date")
    out = rows.write.partitionBy("symbol").mode("overwrite")
    out.csv(path, header=True) if fmt == "csv" else out.parquet(path)


def save_bar_table(bars: DataFrame, name: str, buckets: int = 64, path: str | None = None) -> None:
    """Write bars as a table in buckets by symbol, each file sorted by symbol and Date.

    Windows, groupings and joins by symbol over the table (load_bar_table) need no exchange, and each bucket is one file, whose
    rows are already in the windows' order. buckets is fixed for the life of a table: as many as its readers have cores, or more.
    """
    out = bars.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol").sortBy("symbol", "Date").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)


def load_bar_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def normalize_quotes(df: DataFrame, names: dict[str, str], order: str) -> DataFrame:
    """Vendor rows to bars: rename by `names`, AdjClose = Close, Dividend 0 and Split 1 where absent; of repeats the last by `order` stays."""
    out = df.withColumnsRenamed(names)
    defaults = {"AdjClose": F.col("Close"), "Dividend": F.lit(0.0), "Split": F.lit(1.0)}
    out = out.withColumns({c: v for c, v in defaults.items() if c not in out.columns})
    return dedupe(out, [order], "last")


def attach_actions(bars: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """Add Dividend (symbol, Date, value) and Split (symbol, Date, text 'a/b'); days without one get 0 and 1."""
    ratio = F.split("split", "/")
    parsed = splits.select(*KEY, div(F.try_element_at(ratio, F.lit(1)).try_cast("double"), F.try_element_at(ratio, F.lit(2)).try_cast("double")).alias("Split"))
    out = bars.drop("Dividend", "Split").join(dividends.select(*KEY, F.col("value").alias("Dividend")), KEY, "left").join(parsed, KEY, "left")
    return out.withColumns({"Dividend": F.coalesce("Dividend", F.lit(0.0)), "Split": F.coalesce("Split", F.lit(1.0))})


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new rows; on a common date the new row holds. Rows with nulls go."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = [c for c in old.columns if c not in KEY]
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*cols), "_new").alias("_r")).select(*KEY, "_r.*").dropna()


def overlay_realtime(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Put a snapshot's values over the bar of its date, column by column; a null in the snapshot keeps the bar's value."""
    cols = [c for c in bars.columns if c not in KEY]
    newer = quotes.select(*KEY, *[F.col(c).alias(f"_{c}") for c in cols if c in quotes.columns])
    out = bars.join(newer, KEY, "full")
    return out.select(*KEY, *[F.coalesce(f"_{c}", c).alias(c) if c in quotes.columns else F.col(c) for c in cols])


def market_dates(bars: DataFrame, benchmarks: dict[str, str]) -> DataFrame:
    """(market, market_date): the last bar of each market's benchmark symbol."""
    which = F.create_map(*[F.lit(x) for market, symbol in benchmarks.items() for x in (symbol, market)])
    return bars.filter(F.col("symbol").isin(*benchmarks.values())).groupBy(which[F.col("symbol")].alias("market")).agg(F.max("Date").alias("market_date"))


def stale_symbols(bars: DataFrame, symbols: DataFrame, dates: DataFrame, oldest: str = "2020-01-01") -> DataFrame:
    """Of symbols (symbol, market), those without bars, with none since `oldest` or behind their market (market, market_date).

    restart is three days before the last bar; null where the whole history is missing or too old.
    """
    last = bars.groupBy("symbol").agg(F.max("Date").alias("last_date"))
    out = symbols.join(last, "symbol", "left").join(dates, "market", "left")
    full = F.col("last_date").isNull() | (F.col("last_date") < F.to_date(F.lit(oldest)))
    behind = F.coalesce(F.col("last_date") < F.col("market_date"), F.lit(False))
    return out.filter(full | behind).select("symbol", "last_date", F.when(~full, F.date_sub("last_date", 3)).alias("restart"))


def classify_symbols(df: DataFrame) -> DataFrame:
    """Add market (us, cn, hk, other) and the vendor's name of the symbol; others keep their own."""
    s = F.col("symbol")
    market = F.when(s.rlike("^[A-Za-z]+$"), "us").when(s.rlike("^[0-9]{6}$"), "cn").when(s.rlike("^[0-9]{5}$"), "hk").otherwise("other")
    mainland = F.concat(s, F.when(s.try_cast("int") < 600000, ".SHE").otherwise(".SHG"))
    out = df.withColumn("market", market)
    m = F.col("market")
    return out.withColumn("vendor_symbol", F.when(m == "us", F.upper("symbol")).when(m == "cn", mainland).when(m == "hk", F.concat(F.substring("symbol", 2, 4), F.lit(".HK"))).otherwise(s))


def explode_pools(pools: DataFrame, text: str = "pools") -> DataFrame:
    """(pool, symbol) rows of JSON maps pool -> list of symbols; entries that are no lists are left out."""
    entries = pools.select(F.explode(F.from_json(text, "map<string,string>")).alias("pool", "_list")).filter(F.col("_list").startswith("["))
    return entries.select("pool", F.explode(F.from_json("_list", "array<string>")).alias("symbol"))


ARTICLE = ("struct<_id:string,headline:struct<main:string>,pub_date:string,news_desk:string,section_name:string,snippet:string,"
           "lead_paragraph:string,web_url:string,word_count:long>")


def flatten_news(pages: DataFrame, text: str = "page") -> DataFrame:
    """One row for each article of JSON pages {response: {docs: [...]}}: of articles with the same _id the least pub_date's stays."""
    docs = pages.select(F.explode(F.from_json(text, f"struct<response:struct<docs:array<{ARTICLE}>>>")["response"]["docs"]).alias("d"))
    first = docs.groupBy(F.col("d._id").alias("_id")).agg(F.min_by("d", F.struct("d.pub_date", "d.web_url")).alias("d"))
    return first.select("_id", F.col("d.headline.main").alias("title"), F.col("d.pub_date").try_cast("timestamp").alias("pub_date"), *[
        F.col(f"d.{c}").alias(out) for c, out in (("news_desk", "desk"), ("section_name", "section"), ("snippet", "snippet"), ("lead_paragraph", "lead"), ("web_url", "url"), ("word_count", "word_count"))])


def session_tag(ts: str | Column, opens: str | Column, market: str = "us") -> Column:
    """pre, open, post or closed for a time and the day's opening time."""
    t, o = (F.col(c) if isinstance(c, str) else c for c in (ts, opens))
    close = o + F.expr("INTERVAL 330 MINUTES" if market == "cn" else "INTERVAL 390 MINUTES")
    pre, post = o - F.expr("INTERVAL 330 MINUTES"), close + F.expr("INTERVAL 4 HOURS")
    return F.when((t >= o) & (t < close), "open").when((t >= pre) & (t < o), "pre").when((t >= close) & (t < post), "post").otherwise("closed")
