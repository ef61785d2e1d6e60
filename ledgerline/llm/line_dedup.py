"""Line dedup with DataFrame operations only.

Lines are reduced to hashes of their keys.  Per key the rows are first reduced
by a map-side aggregate (salted by document, so a line that stands in a third
of all documents never meets in one task) to the first occurrence of each salt;
these are dealt by range of the hash with a secondary sort by document (largest
first) and position, and the first row of each key in that order names its
keeper.  What comes back per document is a compressed keep bitmap, never a
text: a map from word number to 64 keep bits, in which the words of all ones
are left out.

A line's key: ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased.
Keys are told apart by two independent 64-bit hashes.

Defined cases: null or empty text is one empty line; rows that share a doc_id
count as one document, and all rows with the keeper's doc_id keep the line;
rows with a null doc_id keep all lines and don't count; a very long text costs
time and memory in proportion to its length; an empty table gives
an empty result; extra columns pass, whatever their names, but for those named
n_lines, n_dropped or kept, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm._work import join_skewed, stored

_STRIP = " \t\n\x0b\f\r"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The key of a line; ``lower`` is exact, and faster, for ASCII."""
    bare = F.btrim(line, F.lit(_STRIP))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOW))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, row_key, pos) of the lines whose keys are long enough."""
    # the key is made below the explode: above it, the whole text would be hashed for each line
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.split("text", "\n", -1).alias("lines"))
    rows = keyed.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= min_chars).select("doc_id", "row_key", "pos", F.btrim("line", F.lit(_STRIP)).alias("line"))
    rows = rows.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(41), "key").alias("h2"), "doc_id", "row_key", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(row_key, keep): for documents that lose lines, their keep bitmap without its words of all ones."""
    lines = stored(_lines(docs, min_chars), "lines")
    # the first place of a key in a document, then in all documents of a salt
    place = F.struct("doc_id", (-F.col("pos")).alias("back"))
    first = lines.groupBy("h1", "h2", "doc_id").agg(F.max(place).alias("place"), F.count("*").alias("n_lines"))
    per_salt = first.groupBy("h1", "h2", F.expr("pmod(doc_id, 16)").alias("salt")).agg(F.max("place").alias("place"), F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"))
    # range partitions with a secondary sort: the keeper is the first row of each key
    ranged = per_salt.repartitionByRange("h1").sortWithinPartitions("h1", "h2", F.desc("place"))
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc("place"))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keys = ranged.select("*", F.row_number().over(stream).alias("nth"), F.sum("n").over(whole).alias("n_docs"), F.sum("n_lines").over(whole).alias("all_lines"))
    keys = keys.drop("n_lines").withColumnRenamed("all_lines", "n_lines")
    keys = stored(keys.where((F.col("nth") == 1) & (F.col("n_docs") >= min_docs)).select("h1", "h2", F.col("place.doc_id").alias("keeper"), "n_lines"), "keepers")
    dropped = join_skewed(lines, keys, ["h1", "h2"], size="n_lines").where("doc_id <> keeper")
    words = dropped.groupBy("row_key", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.expr("bit_or(shiftleft(1L, pos % 64))")).alias("bits"))
    return words.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _dense(bitmaps: DataFrame) -> DataFrame:
    """(row_key, dense): the words of each bitmap up to its last, those left out written as all ones.

    It is made before the join, so once a document, and in one pass: a look into
    the map for each line would cost the square of a text's length.
    """
    words = bitmaps.select("row_key", F.sort_array(F.map_entries("keep")).alias("e"))

    def filled(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get("e", i - 1)["key"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), x["key"] - before - 1), F.array(x["value"]))

    return words.select("row_key", F.flatten(F.transform("e", filled)).alias("dense"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and ``kept``, the lines that stay."""
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    # a document's columns travel as one, so that no name of theirs meets another
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in extra]).alias("doc"))
    rows = rows.join(_dense(bitmaps).hint("shuffle_merge"), "row_key", "left")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    lines = F.split(text, "\n", -1)

    def stays(_: Column, i: Column) -> Column:
        bit = F.call_function("getbit", F.get("dense", F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64)).cast("int"))
        return F.coalesce(bit, F.lit(1)) == 1

    out = rows.select(
        "doc",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("dense", F.lit(0), lambda a, b: a + 64 - F.bit_count(b)), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dense").isNull(), text).otherwise(F.array_join(F.filter(lines, stays), "\n")).alias("kept"),
    )
    return out.select(*[F.col(f"doc.`{c}`") for c in extra], "n_lines", "n_dropped", "kept")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept; see the module for the rule."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
