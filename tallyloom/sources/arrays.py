"""Items of one JSON array that is larger than a task: read in splits, cut where objects end, kept in order.

A file is read in pieces that end at ``}``. Whether a piece begins inside a string, and how deep it ends, depends on all
before it, but only through two numbers: the parity of quotes and the sum of brackets. Each piece has both sums for either
beginning; splits, of which there are few, add them up, and pieces then know where they are within their split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import kept

#: What stands before the first item: a bracket, or an object whose ``items`` come after plain values alone.
BARE = re.compile(r"\s*\[")
WRAPPED = re.compile(r'\s*\{(?:\s*"[^"\\]*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^\[\]{}",\s]+)\s*,)*\s*"items"\s*:\s*\[')
#: Characters in which the head must end.
HEAD = 1 << 16


def _brackets(bare: Column, odd: Column, inside: bool) -> Column:
    """Brackets that a piece opens less those that it closes, its last one included, if it begins inside a string or not."""
    outside = F.regexp_replace(F.concat(F.lit('"'), bare) if inside else bare, '"[^"]*("|$)', "")
    count = lambda kinds: F.length(F.regexp_replace(outside, f"[^{kinds}]", ""))
    ends_outside = odd == (1 if inside else 0)
    return (count(r"{\[") - count(r"\]") - ends_outside.cast("int")).cast("long")


def array_items(spark: SparkSession, path: str) -> DataFrame | None:
    """n (from 0) and item (text) of the objects of one file that is a JSON array or an object with ``items``.

    None if the file begins as neither, or its ``items`` come after nested values: such a file must be read whole. What isn't an
    object among the items, a missing or doubled comma, an array without an end or anything after a bare one raises; what an object
    has after its ``items`` isn't looked at.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    top = raw.where("_metadata.file_block_start = 0").select(F.substring("value", 1, HEAD).alias("head")).first()
    if top is None:
        return None
    base, head = next(((d, x) for d, x in ((1, BARE.match(top.head)), (2, WRAPPED.match(top.head))) if x), (0, None))
    if head is None:
        return None
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no escape crosses the end of a piece: ``\}`` isn't JSON
    odd = F.length(F.regexp_replace(bare, '[^"]', "")) % 2
    pieces = kept(raw.select(
        F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"), odd.alias("odd"), _brackets(bare, odd, False).alias("out"), _brackets(bare, odd, True).alias("in"),
        F.ltrim(F.regexp_replace(F.substring("value", 1, 64), r"\s", " ")).startswith("]").alias("shuts"), "value"), "json-pieces")
    first = pieces.agg(F.min(F.struct("s", "m")).alias("at")).first()["at"]
    before = Window.partitionBy("s").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("s").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # over splits
    none = F.lit(0).cast("long")
    quoted = F.coalesce(F.sum("odd").over(before), none)
    begin = lambda state: F.when((quoted + state) % 2 == 1, F.col("in")).otherwise(F.col("out"))
    either = pieces.select("s", "m", "odd", begin(0).alias("d0"), begin(1).alias("d1"), quoted.alias("quoted"), "shuts")
    sums = either.groupBy("s").agg(F.sum("odd").alias("odd"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    starts = sums.withColumn("state", F.coalesce(F.sum("odd").over(earlier), none) % 2)
    starts = starts.withColumn("depth", F.coalesce(F.sum(F.when(F.col("state") == 1, F.col("d1")).otherwise(F.col("d0"))).over(earlier), none)).select("s", "state", "depth")
    placed = either.join(F.broadcast(starts), "s").withColumn("d", F.when(F.col("state") == 1, F.col("d1")).otherwise(F.col("d0")))
    after = F.col("depth") + F.sum("d").over(upto)
    outside = (F.col("state") + F.col("quoted") + F.col("odd")) % 2 == 0
    marks = kept(placed.select("s", "m", ((after == base) & outside).alias("ends"), ((after - F.col("d") == base) & ((F.col("state") + F.col("quoted")) % 2 == 0) & F.col("shuts")).alias("shuts")), "json-marks")
    shut = marks.where("shuts").agg(F.min(F.struct("s", "m")).alias("at")).first()["at"]
    if shut is None:
        rest = top.head[head.end():].strip()
        if rest == "]" or rest[:1] == "]" and base == 2:
            return spark.createDataFrame([], "n long, item string")
        raise ValueError(f"{path}: the array doesn't end")
    there = (F.col("s") < shut["s"]) | ((F.col("s") == shut["s"]) & (F.col("m") < shut["m"]))
    if base == 1 and [r.v for r in pieces.where(~there).select(F.substring(F.regexp_replace("value", r"\s", ""), 1, 2).alias("v")).limit(2).collect()] != ["]"]:
        raise ValueError(f"{path}: the array doesn't end the file")
    marks = marks.where(there)
    counts = marks.groupBy("s").agg(F.count_if("ends").alias("n")).select("s", F.coalesce(F.sum("n").over(earlier), none).alias("n0"))
    numbered = marks.join(F.broadcast(counts), "s").select("s", "m", (F.col("n0") + F.coalesce(F.count_if("ends").over(before), none)).alias("n"))
    at_head = (F.col("s") == first["s"]) & (F.col("m") == first["m"])
    text = F.when(at_head, F.substring("value", head.end() + 1, 2**31 - 1)).otherwise(F.col("value"))
    parts = pieces.select("s", "m", text.alias("value")).join(numbered, ["s", "m"])
    whole = parts.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("s", "m", "value")))["value"].alias("parts"))  # the pieces of one item
    item = F.concat(F.array_join("parts", "}"), F.lit("}"))
    comma = F.regexp_extract(item, r"^\s*(,?)\s*\{", 0)
    good = (F.length(comma) > 0) & (F.contains(comma, F.lit(",")) == (F.col("n") > 0))
    bad = F.raise_error(F.concat(F.lit("not an object: "), F.substring(item, 1, 80)))
    return whole.select("n", F.when(good, F.regexp_replace(item, r"^[\s,]*", "")).otherwise(bad).alias("item"))


def is_large(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one file that Spark reads in more than one split."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)  # none for a path that isn't there
    if not found or len(found) != 1:
        return False
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return found[0].isFile() and found[0].getLen() > most
