"""Benchmark decontamination: exact shingle containment join, in SQL functions.

Short items are searched inside long documents. An item's signature is the m smallest of
its shingle hashes (bottom-m MinHash); items are partitioned by size, and m is set for
each partition so that a document holding the asked share of any of its items must hold at
least one signature shingle. The signatures prune nothing here: all windows are joined with
all item shingles, and a pair that passes always holds a signature shingle.
A pair is decided exactly: distinct item shingles that the document holds, word
by word, against the size of the item's set.

Items with fewer than k words are one shingle of their own width. The benchmark is a stated
query set: its table is broadcast while its counted rows stay under a bound and shuffled
beyond it. Null or blank texts and items hold nothing and are held by nothing. Repeated
documents are one document of that id; repeated items are items each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import pick
from .wordstats import words

#: rows of item shingles (about 200 bytes each) that are broadcast at most
BROADCAST_ROWS = 250_000


def _windows(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """One row per window of ``width`` words: w0, w1, ... ; the others stay empty."""
    n = F.size("words") - (width - 1)
    zipped = F.arrays_zip(*[F.slice("words", F.lit(i + 1), n).alias(f"w{i}") for i in range(width)])
    return df.where(F.size("words") >= width).select(*keep, F.inline(zipped))


def _tokens(df: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    return pick(df, **{name: id_col, "text": text_col}).select(
        name, words(F.lower(F.coalesce("text", F.lit("")))).alias("words"))


def item_shingles(items: DataFrame, k: int, percent: int) -> DataFrame:
    """item, width, w0.., h, size and in_sketch: distinct shingles of every item."""
    sized = items.withColumn("width", F.least(F.size("words"), F.lit(k))).where("width > 0")
    flat = None
    for width in range(1, k + 1):
        part = _windows(sized.where(F.col("width") == width), width, "item", "width")
        part = part.select("item", "width", *[F.col(f"w{i}") if i < width else F.lit(None).cast("string").alias(f"w{i}") for i in range(k)])
        flat = part if flat is None else flat.union(part)
    cols = [f"w{i}" for i in range(k)]
    flat = flat.distinct().withColumn("h", F.xxhash64(*cols))
    of_item = W.partitionBy("item")
    flat = flat.withColumn("size", F.count(F.lit(1)).over(of_item)).withColumn("nth", F.row_number().over(of_item.orderBy("h", *cols)))
    # sizes of one partition differ by less than a factor of two
    bound = F.pow(F.lit(2), F.floor(F.log2("size")) + 1).cast("long") - 1
    m = bound - F.ceil(percent * bound / 100) + 1
    return flat.withColumn("in_sketch", F.col("nth") <= m).drop("nth")


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every document that holds at least ``percent``
    per cent of an item's shingles."""
    items = item_shingles(_tokens(benchmark, "item", item_col, item_text), k, percent)
    # the benchmark, not the corpus: how many rows, and which widths
    widths = {r["width"]: r["n"] for r in items.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(widths.values()) <= BROADCAST_ROWS
    hits = None
    source = _tokens(docs, "doc", id_col, text_col)
    for width in sorted(widths) or [k]:
        cols = [f"w{i}" for i in range(width)]
        side = items.where(F.col("width") == width).select("item", "size", "in_sketch", "h", *[F.col(c).alias(f"i_{c}") for c in cols])
        blank = [F.lit(None).cast("string")] * (k - width)
        found = _windows(source, width, "doc").withColumn("h", F.xxhash64(*cols, *blank))
        equal = [F.col(c) == F.col(f"i_{c}") for c in cols]
        joined = found.join(F.broadcast(side) if small else side, on=[found["h"] == side["h"], *equal])
        part = joined.select("doc", "item", "size", "in_sketch", side["h"].alias("h"), *cols,
                             *[F.lit(None).cast("string").alias(f"w{i}") for i in range(width, k)])
        hits = part if hits is None else hits.union(part)
    distinct = hits.groupBy("doc", "item", "size", "in_sketch", *[f"w{i}" for i in range(k)]).agg(F.count(F.lit(1)).alias("times"))
    return (distinct.groupBy("doc", "item", "size").agg(F.count(F.lit(1)).alias("n_shared"), F.max("in_sketch").alias("met"))
            .where(F.col("met") & (100 * F.col("n_shared") >= percent * F.col("size")))
            .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("size").cast("long").alias("n_item"), "n_shared"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    held = contained_items(docs, benchmark, id_col=id_col, text_col=text_col, **more).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, F.col(id_col).eqNullSafe(F.col("_held")), "left_anti")
