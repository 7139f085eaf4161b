"""Benchmark decontamination with DataFrame functions only.

Texts become words (A-Z lower-cased; digits, letters and all non-ASCII
characters are word characters). Every run of ``n`` consecutive benchmark
words is a window; a benchmark item of fewer words is one window. The windows
are a broadcast hash set, document windows are looked up by their hash, each
hit is verified word by word, and documents or spans are removed. Too many
windows for a broadcast are a bitmap of hashes, of bounded size, that document
windows must pass before they are shuffled to the windows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import measured, table, written

#: Everything that separates words, as a character class.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same in a text that isn't lower-cased.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most windows, and item ids in them, that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 300_000
#: Most bytes of windows and item ids that are broadcast, as words may be very long.
BROADCAST_BYTES = 64 << 20
#: Bits of a row of the bitmap; bits for each window; most bits, 32 MB of them, that are broadcast.
ROW_BITS, WINDOW_BITS, MOST_BITS = 32_768, 32, 1 << 28
#: Most contaminated texts, named by two longs, that are broadcast.
BROADCAST_TEXTS = 100_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, other characters as they are; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), f"{SEPARATORS}+"), "")


def _windows_of(w: Column, length: int) -> Column:
    """(place, length, hash) of all runs of ``length`` words; none in a shorter text."""
    run = F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.struct(i.alias("place"), F.lit(length).alias("length"), F.xxhash64(F.slice(w, i, length)).alias("hash")))
    return F.when(F.size(w) >= length, run).otherwise(F.expr("array()").cast("array<struct<place:int,length:int,hash:bigint>>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(hash, length, window, items): each distinct window once, with the items that hold it.

    Items without words or without an id are left out.
    """
    w = F.col("_w")
    runs = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n))).otherwise(F.array(w))
    return (
        benchmark.where("item_id is not null")
        .select("item_id", words(F.col("text")).alias("_w"))
        .where(F.size(w) > 0)
        .select("item_id", F.explode(runs).alias("window"))
        .groupBy("window")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(F.xxhash64("window").alias("hash"), F.size("window").alias("length"), "window", "items")
    )


def _bit(of_hash: Column, n_bits: int) -> Column:
    """A hash's place in a bitmap, from 1 as Spark numbers bits."""
    return F.pmod(F.xxhash64(of_hash), F.lit(n_bits)) + 1


def hash_bits(windows: DataFrame, n_bits: int) -> DataFrame:
    """(bits_row, bits): the windows' hashes as a bitmap of n_bits, ROW_BITS of them a row, as longs."""
    bit = _bit(F.col("hash"), n_bits)
    rows = windows.groupBy(F.bitmap_bucket_number(bit).alias("bits_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    long_at = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return rows.select("bits_row", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), long_at).alias("bits"))


def may_hit(rows: DataFrame, bits: DataFrame, n_bits: int, stays: Column) -> DataFrame:
    """Rows whose hash has its bit set, and those that stay in any case; false hits are about one in WINDOW_BITS."""
    at = F.bitmap_bit_position(_bit(F.col("hash"), n_bits))
    # Bytes lie in a long from the highest, bits in a byte from the lowest.
    shift = (56 - F.floor(at % 64 / 8) * 8 + at % 8).cast("int")
    is_set = F.call_function("shiftright", F.get("bits", F.floor(at / 64).cast("int")), shift).bitwiseAND(F.lit(1).cast("long")) == 1
    met = rows.withColumn("bits_row", F.bitmap_bucket_number(_bit(F.col("hash"), n_bits))).join(F.broadcast(bits), "bits_row", "left")
    return met.where(F.coalesce(is_set, F.lit(False)) | stays).drop("bits_row", "bits")


def _hits(docs: DataFrame, keys: list[str], benchmark: DataFrame, n: int, keep_all: bool) -> DataFrame:
    """Rows (keys, n_words, place, length, items) of verified hits; with ``keep_all`` one more row per document."""
    octets = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda total, x: total + F.octet_length(x))
    none = F.lit(0).cast("long")
    windows, size = measured(
        benchmark_windows(benchmark, n), "windows", n=F.count(F.lit(1)), m=F.coalesce(F.sum(F.size("items")), none), octets=F.coalesce(F.sum(octets("window") + octets("items")), none), lengths=F.collect_set("length")
    )
    lengths = sorted(size["lengths"]) or [n]
    rows = docs.select(*keys, words(F.col("text")).alias("_w"))
    runs = F.concat(*(_windows_of(F.col("_w"), k) for k in lengths))
    rows = rows.select(*keys, F.size("_w").cast("long").alias("n_words"), "_w", runs.alias("_runs"))
    # Outer also where only hits are wanted: an inner explode gets a filter on the
    # size of its array, which is pushed below and works out all of _runs again.
    rows = rows.select(*keys, "n_words", "_w", F.posexplode_outer("_runs").alias("_at", "_run"))
    rows = rows.select(*keys, "n_words", "_w", "_at", "_run.place", "_run.length", "_run.hash")
    how = "left" if keep_all else "inner"
    if max(size["n"], size["m"]) <= BROADCAST_WINDOWS and size["octets"] <= BROADCAST_BYTES:
        found = rows.join(F.broadcast(windows.select("hash", "window", "items")), "hash", how)
        there = F.slice("_w", F.col("place"), F.col("length"))
    else:
        # Only windows whose hash may be there, and each document's first, travel; with their own words alone.
        n_bits = ROW_BITS
        while n_bits < min(WINDOW_BITS * size["n"], MOST_BITS):
            n_bits *= 2
        bits = written(hash_bits(windows, n_bits), "window-bits")
        rows = may_hit(rows, bits, n_bits, F.coalesce(F.col("_at") == 0, F.lit(True)) if keep_all else F.lit(False))
        found = rows.withColumn("_there", F.slice("_w", F.col("place"), F.col("length"))).drop("_w").join(windows.select("hash", "window", "items"), "hash", how)
        there = F.col("_there")
    found = found.select(*keys, "n_words", "_at", "place", "length", F.when(F.col("window").isNotNull() & (F.col("window") == there), F.col("items")).alias("items"))
    is_hit = F.col("items").isNotNull()
    return found.where(is_hit | F.coalesce(F.col("_at") == 0, F.lit(True)) if keep_all else is_hit)


def _covered(spans: Column) -> Column:
    """How many words lie in spans (place, length), which may overlap."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["reach"], s["place"] + s["length"]).alias("reach"),
        (acc["total"] + F.greatest(F.lit(0), s["place"] + s["length"] - F.greatest(acc["reach"], s["place"]))).cast("long").alias("total"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["total"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    Null, empty and wordless texts have no words and no hits. Repeated rows
    each keep a row; a null doc_id stays null; other columns are not read, so
    their names can't clash. An empty benchmark contaminates nothing.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), F.col("text"))
    rows = _hits(keyed, ["_row", "doc_id"], benchmark, n, keep_all=True)
    is_hit = F.col("items").isNotNull()
    grouped = rows.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(is_hit, F.struct("place", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return grouped.select(
        "doc_id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.array_sort("spans").alias("spans"),
        "items",
    )


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text: its verdict depends on nothing else."""
    return [F.xxhash64(text).alias("_key1"), F.xxhash64(F.lit(1), text).alias("_key2")]


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows whose text holds no window of the benchmark, with all their columns.

    Rows with null, empty or wordless texts stay; copies share their verdict.
    """
    keyed = docs.select(*_text_key(F.col("text")), "text")
    # Written first, so that documents are shuffled only where many texts go.
    bad, seen = measured(_hits(keyed, ["_key1", "_key2"], benchmark, n, keep_all=False).select("_key1", "_key2").distinct(), "contaminated", n=F.count(F.lit(1)))
    bad = F.broadcast(bad) if seen["n"] <= BROADCAST_TEXTS else bad
    left = docs.select(F.struct("*").alias("_doc"), *_text_key(F.col("text")))
    return left.join(bad, ["_key1", "_key2"], "left_anti").select("_doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All rows, their texts without the words of verified hits and the separators after them."""
    keyed = docs.select(*_text_key(F.col("text")), "text")
    spans = _hits(keyed, ["_key1", "_key2"], benchmark, n, keep_all=False).groupBy("_key1", "_key2").agg(F.collect_set(F.struct("place", "length")).alias("_spans"))
    word = RAW_SEPARATORS.replace("[", "[^", 1)
    units = F.regexp_extract_all("text", F.lit(f"({word}+{RAW_SEPARATORS}*)"), F.lit(1))
    kept = F.filter(units, lambda u, i: ~F.exists("_spans", lambda s: (i + 1 >= s["place"]) & (i + 1 < s["place"] + s["length"])))
    cleaned = F.concat(F.regexp_extract("text", f"^{RAW_SEPARATORS}*", 0), F.array_join(kept, ""))
    left = docs.select(F.struct("*").alias("_doc"), *_text_key(F.col("text")), "text")
    joined = left.join(spans, ["_key1", "_key2"], "left")
    return joined.select(F.col("_doc").withField("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cleaned)).alias("_doc")).select("_doc.*")


def op2_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return result.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: DuckDB, window by window.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, win, n FROM (
    SELECT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win
    FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS win
  FROM w, sizes WHERE len(ws) >= n),
hits AS (SELECT p.r, p.p, p.n, i.item_id FROM places p JOIN items i ON i.n = p.n AND i.win = p.win),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::varchar AS s FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
