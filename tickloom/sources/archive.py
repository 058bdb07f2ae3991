"""Readers of the market archive: day files, append-only streams, snapshots, payloads and reference lists.

Every reader judges rows one by one and says why it refuses one; missing values are null. Day files lie in folders
`session_date=<date>` under a root.
"""

from __future__ import annotations

import csv
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of a day file's bars, its time stamps, and the marker that ends a block of a stream.
FIELDS = ("open", "high", "low", "close", "volume")
STAMP = "yyyy-MM-dd HH:mm:ss"
ZONE, OFFSET = " IST", "+05:30"
END = "#END"
SESSION = (9 * 60 + 15, 15 * 60 + 30)


def number(c: Column) -> Column:
    """A text as a finite number, else null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def epoch(c: Column) -> Column:
    """Seconds since 1970 of a stamp of the exchange's zone, null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(F.when(c.endswith(ZONE), F.concat(F.regexp_replace(c, f"{ZONE}$", ""), F.lit(OFFSET))), F.lit(f"{STAMP}XXX")))


def stamp(seconds: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), OFFSET), STAMP), F.lit(ZONE))


def judged(rows: DataFrame, key: str, position: str, *more: str) -> DataFrame:
    """key, epoch, the fields as numbers, and reason: null for a good row. Of several good rows of a minute the first one counts."""
    values = rows.select(*more, F.col(key), F.col(position).alias("position"), epoch(F.col("timestamp")).alias("epoch"), *[number(F.col(x)).alias(x) for x in FIELDS])
    o, h, low, c, v = map(F.col, FIELDS)
    reason = F.when(F.col("epoch").isNull(), "bad_timestamp").when((o + h + low + c + v).isNull(), "missing_value")
    reason = reason.when((h < F.greatest(o, c)) | (low > F.least(o, c)) | (h < low) | (v < 0), "invalid_ohlc")
    values = values.withColumn("reason", reason)
    place = F.row_number().over(W.partitionBy(*more, key, "epoch", F.col("reason").isNull()).orderBy("position"))
    return values.withColumn("reason", F.when(F.col("reason").isNull() & (place > 1), "duplicate_minute").otherwise(F.col("reason"))).drop("position")


def bars(rows: DataFrame, drop_filler: bool = False) -> DataFrame:
    """The good rows of judged ones; flat bars without volume may count as minutes without a trade."""
    o, h, low, c, v = map(F.col, FIELDS)
    filler = (v == 0) & (o == h) & (h == low) & (low == c)
    return rows.where(F.col("reason").isNull() & ~(F.lit(drop_filler) & filler)).drop("reason")


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...], **options: str) -> DataFrame:
    rows = spark.read.options(header=True, **options).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    return rows.withColumn("position", F.monotonically_increasing_id())  # a gzip file is one task's, in order


def read_bars(spark: SparkSession, root: str, session_date: str | None = None, key: str = "symbol") -> DataFrame:
    """Judged bars of one archived day, or of all days with their session_date."""
    if session_date is not None:
        return judged(_csv(spark, f"{root}/session_date={session_date}", (key, "timestamp", *FIELDS)), key, "position")
    rows = _csv(spark, root, (key, "timestamp", *FIELDS, "session_date"))
    return judged(rows, key, "position", "session_date")


def days(rows: DataFrame) -> DataFrame:
    return rows.select("session_date").distinct()


def session_days(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """Days (session_date, rows) that hold at least `least` of the upper median of the days' rows; days of unknown rows count."""
    known = rows.where("rows is not null")
    middle = known.agg(F.array_sort(F.collect_list("rows")).alias("all")).select(F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("middle"))
    return rows.join(F.broadcast(middle)).where(F.col("rows").isNull() | F.col("middle").isNull() | (F.col("rows") >= F.lit(least) * F.col("middle"))).select("session_date", "rows")


def manifests(spark: SparkSession, root: str, file: str = "equity", historical: str = "HISTORICAL") -> DataFrame:
    """session_date, rows of the file (null where none are told) and whether the day was loaded afterwards."""
    schema = f"session_date string, source string, files struct<`{file}`: struct<rows: bigint>>"
    told = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(root)
    return told.select("session_date", F.col(f"files.{file}.rows").alias("rows"), F.coalesce(F.col("source") == historical, F.lit(False)).alias("is_historical"))


def payload_bars(payloads: DataFrame) -> DataFrame:
    """Judged bars of live payloads (column json): as archived rows are judged."""
    candle = "struct<timestamp: string, open: string, high: string, low: string, close: string, volume: string>"
    told = F.from_json("json", f"session struct<date: string>, stocks map<string, struct<candles_1m: array<{candle}>>>")
    rows = payloads.select(told.alias("p")).select(F.col("p.session.date").alias("session_date"), F.explode("p.stocks").alias("symbol", "stock"))
    rows = rows.select("session_date", "symbol", F.posexplode("stock.candles_1m").alias("position", "candle")).select("session_date", "symbol", "position", "candle.*")
    return judged(rows.where("session_date is not null"), "symbol", "position", "session_date")


def blocks(spark: SparkSession, root: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of the complete blocks of append-only files: up to the last end marker of each file, headers and torn rows left out.

    Lines are read as such, so a large file is many tasks' work; `position` is the start of the line's part of the file and its place there.
    """
    lines = spark.read.text(root).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("position"), F.col("value").alias("line"))
    last = lines.where(F.col("line").startswith(f"{END} ")).groupBy("file").agg(F.max("position").alias("last"))
    rows = lines.join(last, "file").where(F.col("position") < F.col("last")).where(~F.col("line").startswith(END) & (F.col("line") != "") & (F.col("line") != ",".join(columns)))
    parts = F.split("line", ",", -1)
    rows = rows.where(F.size(parts) == len(columns)).select("file", "position", parts.alias("parts"))
    return rows.select("file", "position", *[F.get("parts", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def archive_first(archive: DataFrame, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The archive's rows and those of the stream whose keys it doesn't have."""
    return archive.unionByName(stream.join(archive.select(*keys).distinct(), keys, "left_anti"))


def latest_snapshots(lines: DataFrame, schema: str, minute: str = "minute") -> DataFrame:
    """Snapshots of JSON lines (file position, value): torn lines are left out, a minute recorded again replaces the earlier one."""
    told = lines.select("position", F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"}).alias("s"))
    told = told.where("s._torn is null and s is not null").select("position", "s.*").drop("_torn").where(F.col(minute).isNotNull())
    return told.groupBy(minute).agg(F.max_by(F.struct(*[c for c in told.columns if c not in ("position", minute)]), "position").alias("s")).select(minute, "s.*")


def chain_files(spark: SparkSession, root: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of gzip CSV files of several members, each with a header or none; a last member that a crash cut short is left out.

    Anything else that can't be read is an error: a broken member before the last, a check sum that is wrong, a row of another width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for text in gzip_members(content, path):
                    rows = [r for r in csv.reader(io.StringIO(text.decode())) if r and r != list(columns)]
                    if wrong := [r for r in rows if len(r) != len(columns)]:
                        raise ValueError(f"{path}: a row of {len(wrong[0])} fields instead of {len(columns)}")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], list(columns))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(root).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{c} string" for c in columns))


def gzip_members(content: bytes, path: str) -> Iterator[bytes]:
    """The members' texts; one at the end of the file that has no end is left out."""
    rest = content
    while rest:
        member = zlib.decompressobj(31)
        try:
            text = member.decompress(rest)
        except zlib.error as x:
            raise ValueError(f"{path}: a broken member, {len(content) - len(rest)} bytes from the start") from x
        if not member.eof:
            return
        yield text
        rest = member.unused_data


def array_candles(bodies: DataFrame, *keys: str) -> DataFrame:
    """Rows of column arrays (timestamp, open, high, low, close, volume: arrays of texts), each with its reason, null for a good one.

    Arrays of different lengths are an error.
    """
    names = ("timestamp", *FIELDS)
    sizes = F.array_distinct(F.array(*[F.size(n) for n in names]))
    same = F.when(F.size(sizes) == 1, F.arrays_zip(*names)).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast("array<struct<timestamp:string,open:string,high:string,low:string,close:string,volume:string>>"))
    rows = bodies.select(*keys, F.posexplode(same).alias("position", "x")).select(*keys, "position", "x.*")
    rows = rows.select(*keys, "position", F.col("timestamp").try_cast("bigint").alias("epoch"), *[number(F.col(c)).alias(c) for c in FIELDS])
    o, h, low, c, v = map(F.col, FIELDS)
    minute = F.floor(F.pmod(F.col("epoch") + 19800, F.lit(86400)) / 60)
    reason = F.when((F.col("epoch") + o + h + low + c + v).isNull(), "non_numeric").when(F.col("epoch") % 60 != 0, "unaligned_timestamp")
    reason = reason.when((minute < SESSION[0]) | (minute >= SESSION[1]), "outside_session")
    reason = reason.when((h < F.greatest(o, c)) | (low > F.least(o, c)) | (low <= 0) | (v < 0), "invalid_ohlc")
    rows = rows.withColumn("reason", reason)
    place = F.row_number().over(W.partitionBy(*keys, "epoch", F.col("reason").isNull()).orderBy("position"))
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (place > 1), "duplicate_minute").otherwise(F.col("reason"))).drop("position")


def daily_reference(bodies: DataFrame, *keys: str) -> DataFrame:
    """day, open and close of daily column arrays: rows of positive numbers, the last one of a day."""
    rows = bodies.select(*keys, F.posexplode(F.arrays_zip("timestamp", "open", "close")).alias("position", "x"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("x.timestamp").try_cast("bigint") + 19800) / 86400).cast("int"))
    rows = rows.select(*keys, "position", day.alias("day"), number(F.col("x.open")).alias("open"), number(F.col("x.close")).alias("close")).where("day is not null and open > 0 and close > 0")
    return rows.groupBy(*keys, "day").agg(F.max_by("open", "position").alias("open"), F.max_by("close", "position").alias("close"))


def depth_frames(frames: DataFrame, *keys: str, levels: int = 20) -> DataFrame:
    """Levels of binary depth frames (column frame): a header of 12 bytes (length, code, -, id), then price, quantity, orders.

    Code 41 is the bid, 51 the ask side. A frame holds one message here; one that is cut short gives no rows.
    """

    def hexed(first: int, n: int) -> Column:
        """n little-endian bytes from place first (of 0) as a whole number."""
        return F.conv(F.concat(*[F.hex(F.substring("frame", first + k + 1, 1)) for k in reversed(range(n))]), 16, 10).cast("long")

    def signed(c: Column) -> Column:
        return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c)

    code = hexed(2, 1)
    good = (hexed(0, 2) == F.length("frame")) & code.isin(41, 51) & (F.length("frame") >= 12 + 16 * levels)
    rows = frames.where(good).select(*keys, signed(hexed(4, 4)).cast("string").alias("security_id"), F.when(code == 41, "bid").otherwise("ask").alias("side"), "frame", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))

    def part(at: int, n: int) -> Column:
        cut = [F.hex(F.expr(f"substring(frame, 13 + 16 * _level + {at + j}, 1)")) for j in reversed(range(n))]
        return F.concat(*cut)

    low, high = F.conv(part(0, 4), 16, 10).cast("long"), F.conv(part(4, 4), 16, 10).cast("long")
    exponent, mantissa = F.shiftright(high, 20).bitwiseAND(2047), high.bitwiseAND((1 << 20) - 1) * float(1 << 32) + low
    price = F.when(high >= 1 << 31, -1.0).otherwise(1.0) * F.when(exponent == 0, mantissa * 2.0**-1074).otherwise((mantissa / float(1 << 52) + 1.0) * F.pow(F.lit(2.0), exponent - 1023.0))
    whole = lambda at: F.conv(part(at, 4), 16, 10).cast("long")
    return rows.select(*keys, "security_id", "side", (F.col("_level") + 1).alias("level"), price.alias("price"), whole(8).alias("quantity"), whole(12).alias("orders"))


def quote_levels(quotes: DataFrame, *keys: str) -> DataFrame:
    """side, level, price, quantity and orders of quotes (column depth: buy and sell arrays); missing numbers are 0."""
    sides = [quotes.select(*keys, F.lit(side).alias("side"), F.posexplode(f"depth.{name}").alias("k", "x")) for side, name in (("bid", "buy"), ("ask", "sell"))]
    rows = sides[0].unionByName(sides[1]).where("x is not null")
    zero = lambda name, kind: F.coalesce(F.col(f"x.{name}").cast(kind), F.lit(0).cast(kind)).alias(name)
    return rows.select(*keys, "side", (F.col("k") + 1).alias("level"), zero("price", "double"), zero("quantity", "long"), zero("orders", "long"))


def master_ids(master: DataFrame, wanted: DataFrame) -> DataFrame:
    """symbol and security_id of each wanted symbol among the exchange's equities: the last one listed; a symbol without one is an error."""
    rows = master.where((F.upper(F.trim("exchange")) == "NSE") & (F.upper(F.trim("instrument")) == "EQUITY") & (F.trim("security_id") != ""))
    rows = rows.groupBy(F.upper(F.trim("trading_symbol")).alias("symbol")).agg(F.max_by(F.trim("security_id"), "position").alias("security_id"))
    named = wanted.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol != ''").distinct().join(rows, "symbol", "left")
    return named.withColumn("security_id", F.coalesce("security_id", F.raise_error(F.concat(F.lit("not in the master: "), "symbol"))))


def front_months(master: DataFrame, wanted: DataFrame, today: Column) -> DataFrame:
    """Of each wanted symbol the future that expires first, today or later: `SYMBOL` or `SYMBOL-...`, so NIFTY isn't BANKNIFTY."""
    name = F.upper(F.trim("trading_symbol"))
    rows = master.where(F.upper(F.trim("instrument")).startswith("FUT")).withColumn("symbol", F.regexp_extract(name, "^[^-]*", 0)).where(F.col("expiry") >= today)
    rows = rows.join(wanted.select(F.upper(F.trim("symbol")).alias("symbol")).distinct(), "symbol", "left_semi")
    first = rows.groupBy("symbol").agg(F.min(F.struct("expiry", "position", "security_id", "trading_symbol")).alias("x"))
    return first.select("symbol", "x.security_id", "x.trading_symbol", "x.expiry").where("security_id != ''")


def rfc_822(c: Column) -> Column:
    """A time like `Mon, 02 Sep 2024 09:15:00 +0530`, null if it is none; the name of the day isn't looked at."""
    return F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def feed_items(feeds: DataFrame, category: str, source: str) -> DataFrame:
    """Items of RSS texts (column xml): id, headline, url, summary, published_at (RFC 822 as a timestamp) and its text."""
    items = feeds.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(0))).alias("item"))
    names = ("title", "link", "description", "pubDate", "guid")
    # An item of flat elements without entities is read by patterns; any other is parsed. Each text is made once, in a step of its own.
    flat = F.regexp_like("item", F.lit(r"^<item>(?:<([A-Za-z]+)>[^<&\r]*</\1>)*</item>$"))
    texts = [F.when(F.col("flat"), F.regexp_extract("item", f"<{n}>([^<]*)</{n}>", 1)).otherwise(F.coalesce(F.xpath_string("item", F.lit(f"item/{n}")), F.lit(""))) for n in names]
    items = items.withColumn("flat", flat).select(*[F.trim(x).alias(n) for n, x in zip(names, texts, strict=True)])
    text = {n: F.col(n) for n in names}
    guid = F.coalesce(*[F.when(text[n] != "", text[n]) for n in ("guid", "link", "title")], F.lit(""))
    when = rfc_822(text["pubDate"])
    return items.select(
        guid.alias("id"), text["title"].alias("headline"), F.lit(source).alias("source"), F.lit(category).alias("category"), text["link"].alias("url"),
        text["description"].alias("summary"), F.unix_seconds(when).alias("published_at"), F.when(text["pubDate"] != "", text["pubDate"]).alias("published_at_raw"),
    )


def latest_observations(rows: DataFrame) -> DataFrame:
    """series_id, value and source_date of each series' latest observation; a value that is no number is null."""
    last = rows.groupBy("series_id").agg(F.max(F.struct("date", "value")).alias("x"))
    return last.select("series_id", number(F.col("x.value")).alias("value"), F.col("x.date").alias("source_date"))


def chain_strikes(chains: DataFrame, *keys: str) -> DataFrame:
    """strike, ce and pe of option chains (column oc: a map from strike texts); keys that are no number are left out."""
    rows = chains.select(*keys, F.explode("oc").alias("name", "pair")).where("pair is not null")
    return rows.select(*keys, number(F.col("name")).alias("strike"), "pair.ce", "pair.pe").where("strike is not null")


def chain_legs(strikes: DataFrame, *keys: str) -> DataFrame:
    """A row for each strike and side that is there, the leg's fields beside."""
    legs = F.explode(F.array(F.struct(F.lit("CE").alias("side"), F.col("ce").alias("leg")), F.struct(F.lit("PE").alias("side"), F.col("pe").alias("leg"))))
    return strikes.select(*keys, "strike", legs.alias("x")).where("x.leg is not null").select(*keys, "strike", "x.side", "x.leg.*")


def universe(payloads: DataFrame, expected: int | None = None) -> DataFrame:
    """symbol and ordinal of symbol lists (exchange, instrument, symbols); a wrong list is an error."""
    rows = payloads.select(F.upper("exchange").alias("exchange"), F.upper("instrument").alias("instrument"), F.filter(F.transform("symbols", lambda s: F.upper(F.trim(s))), lambda s: s != "").alias("symbols"))
    wrong = F.when(F.coalesce(F.col("exchange"), F.lit("")) != "NSE", "the exchange must be NSE").when(F.coalesce(F.col("instrument"), F.lit("")) != "EQUITY", "the instrument must be EQUITY")
    wrong = wrong.when(F.coalesce(F.size("symbols"), F.lit(0)) <= 0, "no symbols").when(F.size(F.array_distinct("symbols")) != F.size("symbols"), "symbols are repeated")
    if expected is not None:
        wrong = wrong.when(F.size("symbols") != expected, f"{expected} symbols are expected")
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<string>")).otherwise(F.col("symbols"))
    return rows.select(F.posexplode(checked).alias("ordinal", "symbol"))


def request_windows(spans: DataFrame, *keys: str, span_days: int = 90, overlap_days: int = 5, lead: bool = True) -> DataFrame:
    """first_day, last_day, from_day: requests that tile first..last once, each beginning some days early."""
    step = span_days - overlap_days + 1
    rows = spans.select(*keys, "last", F.explode(F.sequence("first", "last", F.expr(f"interval {step} days"))).alias("first_day"))
    return rows.select(*keys, "first_day", F.least(F.date_add("first_day", step - 1), "last").alias("last_day"), F.date_sub("first_day", overlap_days if lead else 0).alias("from_day"))
