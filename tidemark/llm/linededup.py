"""Line deduplication by a suffix array over line-id sequences, built by distributed prefix doubling.

Texts are sequences of line ids. Round k of the doubling ranks the line runs of length 2^k: a position's pair (rank of its run,
rank of the run 2^k lines on) is aggregated, pairs that occur once are resolved and leave, the others are sorted and get
order-preserving ranks; that is the suffix array's order of the unresolved suffixes. So the work shrinks to what does repeat,
and no suffix crosses its document's end.

The longest-common-prefix intervals are then descended from the longest runs to the shortest: an interval is the set of
positions that share L lines, named by L and its earliest position. In step k, members that share the next 2^k lines as well form a
deeper interval; all but its earliest member move there, the earliest stays and stands for them there too. At the end a position's interval
tells its longest run that occurs earlier. Runs of at least `min_words` words are maximal repeated runs: their earliest copy
stays, later copies are deleted. What shorter runs leave is the caller's choice, so min_words has no default, and `effect` measures it.

A line, a pair of runs or a run that very many documents hold is only ever aggregated and joined, in joins that count its rows first and
deal them over many tasks, never gathered.

Order of copies: by doc_id (null first), then by text digest, then by line. Defined results: null text stays null, and empty text
empty; rows that repeat both id and text are one document and are cut alike; a document whose every line goes keeps an empty
text (removed_lines = n_lines tells it); an empty table gives an empty result; a text of 2^28 lines or more than 2^35 documents that repeat lines
raise an error; other columns are carried along, but for those named removed, n_lines or removed_lines, whose place the results take.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest

from .common import Stage, hot_keys, ship, slices, split_join, table, unused, without

MIN_WORDS = 25
LINE_BITS = 28


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, hi, lo, before, upto): each line's 128-bit id and the words before it and up to its end."""

    def run(batches):
        for b in slices(batches):
            at, line, hi, lo, before, upto = [], [], [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                words = 0
                if t and t.count("\n") >= 1 << LINE_BITS:
                    raise ValueError(f"a text has more than {1 << LINE_BITS} lines")
                for n, x in enumerate(t.split("\n") if t else ()):
                    h = xxh3_128_intdigest(x)
                    at.append(k)
                    line.append(n)
                    hi.append(h >> 64)
                    lo.append(h & 0xFFFFFFFFFFFFFFFF)
                    before.append(words)
                    words += len(x.split())
                    upto.append(words)
            at = pa.array(at, pa.int32())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), long(line), signed(hi), signed(lo), long(before), long(upto)], ["doc_id", "text_key", "line", "hi", "lo", "before", "upto"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, line long, hi long, lo long, before long, upto long")


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """The keys with ranks in their order: ids of a range-sorted frame ascend over its partitions."""
    return keys.sort(*by).withColumn("rank", F.monotonically_increasing_id())


def _numbered(stage: Stage, ids: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_key) with dense numbers in their order: counts of the sorted parts are added up, one row a part."""
    parts = stage.write(ids.distinct().sort("doc_id", "text_key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = parts.groupBy(part.alias("part")).count()
    first = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    doc = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    too_many = F.raise_error(F.lit(f"more than {1 << (63 - LINE_BITS)} documents repeat lines")).cast("long")
    return parts.withColumn("part", part).join(F.broadcast(first), "part").select("doc_id", "text_key", F.when(doc < 1 << (63 - LINE_BITS), doc).otherwise(too_many).alias("doc"))


def repeated_runs(lines: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, text_key, line, length, words): for each position with an earlier copy its longest run that occurs earlier."""
    shared = stage.write(_ranked(lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hi", "lo"))
    lines_of = ["hi", "lo"]
    kept = stage.write(split_join(lines, shared.drop("n"), lines_of, hot_keys(shared, lines_of, lines.count()), F.struct("doc_id", "line")).drop(*lines_of))
    numbers = stage.write(_numbered(stage, kept.select("doc_id", "text_key")))
    at = kept.join(numbers, kept["doc_id"].eqNullSafe(numbers["doc_id"]) & (kept["text_key"] == numbers["text_key"]))
    base = stage.write(at.select((F.shiftleft("doc", LINE_BITS) + F.col("line")).alias("pos"), "rank", "before", "upto").distinct())
    levels, total = [base.select("pos", "rank")], base.count()
    while True:
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy(F.shiftright("pos", LINE_BITS)).orderBy("pos").rangeBetween(step, step)
        pairs = levels[-1].withColumn("next", F.max("rank").over(ahead)).where("next is not null").withColumnRenamed("rank", "one")
        found = stage.write(_ranked(pairs.groupBy("one", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "one", "next"))
        if found.isEmpty():
            break
        two = ["one", "next"]
        levels.append(stage.write(split_join(pairs, found.drop("n"), two, hot_keys(found, two, total), "pos").select("pos", "rank")))
        stage.drop(found)
    none = F.lit(-1).cast("long")
    items = base.select(F.lit(0).cast("long").alias("len"), none.alias("head"), "pos")
    item = lambda length, head: F.struct(length.alias("len"), head.alias("head"), F.col("pos"))
    for k in reversed(range(len(levels))):
        level = levels[k].withColumnRenamed("pos", "there")
        told = items.join(level, F.col("pos") + F.col("len") == F.col("there"), "left").select("len", "head", "pos", "rank")
        met = told.where("rank is not null")
        run = ["len", "head", "rank"]
        heads = stage.write(met.groupBy(*run).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        judged = split_join(met, heads.drop("n"), run, hot_keys(heads, run, total), "pos", "left")
        same, deeper = item(F.col("len"), F.col("head")), item(F.col("len") + (1 << k), F.col("first"))
        moves = F.when(F.col("first").isNull(), F.array(same)).when(F.col("pos") != F.col("first"), F.array(deeper)).otherwise(F.array(same, deeper))
        new = stage.write(told.where("rank is null").drop("rank").unionByName(judged.select(F.explode(moves).alias("i")).select("i.*")))
        stage.drop(heads, *([items] if hasattr(items, "staged_at") else []), *([levels[k]] if k else []))
        items = new
    runs = items.where("len > 0 and pos <> head").select("pos", "len")
    ends = base.select(F.col("pos").alias("end"), "upto")
    runs = runs.join(base.select("pos", "before"), "pos").join(ends, F.col("pos") + F.col("len") - 1 == F.col("end"))
    runs = runs.select(F.shiftright("pos", LINE_BITS).alias("doc"), F.col("pos").bitwiseAND((1 << LINE_BITS) - 1).alias("line"), F.col("len").alias("length"), (F.col("upto") - F.col("before")).alias("words"))
    return runs.join(numbers, "doc").drop("doc")


def dedup_lines(docs: DataFrame, *, min_words: int) -> DataFrame:
    """The documents with later copies of repeated runs cut out, and n_lines, removed_lines, removed (runs as start, length)."""
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "linededup")
    docs = without(docs, "removed", "n_lines", "removed_lines")
    id_, key, at_key = unused(docs, "id", "key", "text_key")
    lines = stage.write(line_rows(docs))
    runs = repeated_runs(lines, stage).where(F.col("words") >= min_words)
    last = Window.partitionBy("doc_id", "text_key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("reach", F.max(F.col("line") + F.col("length")).over(last)).where("reach is null or line + length > reach")
    runs = runs.withColumn("start", F.greatest("line", F.coalesce("reach", F.lit(0)))).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), "start", (F.col("line") + F.col("length") - F.col("start")).alias("length"))
    cuts = stage.write(runs.groupBy(id_, key).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("removed")))
    stage.drop(lines)
    cuts = cuts.hint("merge")  # the cuts grow with the corpus, so they are never broadcast
    out = docs.withColumn(at_key, F.xxhash64("text")).join(cuts, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(at_key) == F.col(key)), "left").drop(id_, key, at_key)
    own = docs.columns
    at = own.index("text")

    def run(batches):
        for b in slices(batches):
            text, n_lines, gone = [], [], []
            for t, cut in zip(b.column(at).to_pylist(), b.column(len(own)).to_pylist(), strict=True):
                lines = t.split("\n") if t else []
                n_lines.append(len(lines))
                if cut:
                    for r in reversed(cut):
                        del lines[r["start"] : r["start"] + r["length"]]
                    t = "\n".join(lines)
                text.append(t)
                gone.append(n_lines[-1] - len(lines))
            columns = [*b.columns[:at], pa.array(text, pa.string()), *b.columns[at + 1 :], pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "n_lines", "removed_lines"])

    schema = T.StructType([*out.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("removed_lines", T.LongType())])
    return out.mapInArrow(run, schema)


def effect(docs: DataFrame, *min_words: int) -> DataFrame:
    """(min_words, n_lines, n_chars, removed_lines, removed_chars) of each choice: what it deletes of the whole table."""
    texts = docs.select("doc_id", "text", F.length("text").alias("n_chars"))
    cut = [dedup_lines(texts, min_words=m).withColumn("removed_chars", F.col("n_chars") - F.length("text")).withColumn("min_words", F.lit(m)) for m in min_words]
    rows = reduce(DataFrame.unionByName, cut)
    return rows.groupBy("min_words").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_lines", "n_chars", "removed_lines", "removed_chars")])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), min_words=MIN_WORDS)
