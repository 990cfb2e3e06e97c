"""Line dedup: repeated runs of lines, found in a suffix array over line ids.

All texts are one sequence of line ids, in order of document id. The suffixes that start at a line are ranked by their first
line, then by their first two, four, ... lines: the rank of a suffix by 2n lines is the rank of its pair (rank of the suffix,
rank of the suffix n lines on), both by n lines. Pairs are counted before they are sorted, so a line that a third of all
documents share is one row of the sort, and suffixes that nothing else shares a rank with leave at once. A class of equal
ranks after n lines is a longest-common-prefix interval of at least n lines: its earliest member stays, the others are later
copies. Sorting stops at `min_lines`: deeper ranks split intervals but change no line's verdict, as every repeated run of at
least `min_lines` lines is the union of its windows of that many lines.

A line is deleted if it lies in a run of `min_lines` lines or more that occurred before, or has `min_words` words itself and
occurred before. Runs never span documents, and short lines that occur by chance stay.

Copies of a whole text are settled by the text: only its first document takes part in the sort.

Null and empty texts are one empty line. Rows that agree in id and text count as one and get the same result. Null ids come first.
An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.frames import any_names, arrow_schema, numbered, pieces, stage


@dataclass(frozen=True)
class LineParams:
    min_lines: int = 4
    min_words: int = 10


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__t1": F.xxhash64(raw), "__t2": F.xxhash64(F.lit(1), raw)})


def line_ids(docs: DataFrame, key: str) -> DataFrame:
    """(key, t1, t2, h1, h2, words): 128-bit ids and words of the lines of every row, as arrays."""
    rows = with_key(docs.select(key, "text")).select(key, "__t1", "__t2", "text")
    schema = T.StructType([*rows.schema.fields[:3], *T.StructType.fromDDL("h1 array<long>, h2 array<long>, words array<int>").fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h1, h2, words = [], [], []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                lines = (raw or b"").split(b"\n")
                both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)
                h1.append(both[:, 0])
                h2.append(both[:, 1])
                words.append(np.fromiter((len(x.split()) for x in lines), np.int32, len(lines)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).cast(target[i].type) for i in range(3)), *(pa.array(x, f.type) for x, f in zip((h1, h2, words), list(target)[3:]))], schema=target)

    return rows.mapInArrow(run, schema)


def ranked(classes: DataFrame, order: list[str]) -> DataFrame:
    """`classes` (order columns, n, first) with `rank`: how many suffixes are smaller."""
    return numbered(classes, [F.col(c) for c in order], "classes", weight="n").withColumnRenamed("before", "rank").drop("ordinal")


def copied_lines(lines: DataFrame, params: LineParams) -> DataFrame:
    """(base, pos): lines to delete. `lines` has pos (place in the whole sequence), base and stop (the text's first place and
    the place after its last), h1, h2, words.
    """
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n > 1")
    at = stage(lines.join(ranked(twice, ["h1", "h2"]), ["h1", "h2"]).select("pos", "base", "stop", "words", "rank", "first"), "suffixes")
    gone = at.filter((F.col("words") >= params.min_words) & (F.col("pos") > F.col("first"))).select("base", "pos")
    at, have = at.drop("words"), 1
    while have < params.min_lines:
        step = min(have, params.min_lines - have)
        later = at.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("rank2"))
        pairs = stage(at.filter(F.col("pos") + have + step <= F.col("stop")).drop("first").join(later, "pos"), "pairs")
        twice = pairs.groupBy("rank", "rank2").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n > 1")
        names = ranked(twice.select(F.col("rank").alias("a"), F.col("rank2").alias("b"), "n", "first"), ["a", "b"])
        at = stage(pairs.join(names.select("a", "b", F.col("rank").alias("_rank"), "first"), (F.col("rank") == F.col("a")) & (F.col("rank2") == F.col("b")))
                   .select("pos", "base", "stop", F.col("_rank").alias("rank"), "first"), "suffixes")
        have += step
    if params.min_lines > 1:
        windows = at.filter("pos > first").select("base", F.explode(F.sequence("pos", F.col("pos") + params.min_lines - 1)).alias("pos"))
    else:
        windows = at.filter("pos > first").select("base", "pos")
    return gone.union(windows).distinct()


@any_names
def drop_copies(docs: DataFrame, params: LineParams = LineParams(), key: str = "doc_id") -> DataFrame:
    """`docs` with the later copies of repeated lines cut from `text`, and `n_lines`, `n_removed` (of the input's lines)."""
    ids = stage(line_ids(docs, key), "line_ids")
    placed = numbered(ids.select(key, "__t1", "__t2", F.size("h1").cast("long").alias("n")).distinct(),
                      [F.asc_nulls_first(key), F.col("__t1"), F.col("__t2")], "places", weight="n").drop("ordinal")
    first = (placed.groupBy("__t1", "__t2").agg(F.min("before").alias("base")))
    first = stage(placed.join(first, ["__t1", "__t2"]).filter(F.col("before") == F.col("base"))
                  .select(F.col(key).alias("__first"), "__t1", "__t2", "base", "n"), "first_places")
    own = ids.join(first, ["__t1", "__t2"]).filter(F.col(key).eqNullSafe(F.col("__first"))).dropDuplicates(["__t1", "__t2"])
    lines = own.select("base", (F.col("base") + F.col("n")).alias("stop"), F.posexplode(F.arrays_zip("h1", "h2", "words")).alias("i", "x")).select(
        (F.col("base") + F.col("i")).alias("pos"), "base", "stop", "x.h1", "x.h2", "x.words")
    gone = copied_lines(lines, params).groupBy("base").agg(F.collect_list((F.col("pos") - F.col("base")).cast("int")).alias("__gone"))
    verdicts = first.join(gone, "base", "left").select("__t1", "__t2", "__first", "__gone")
    own_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = with_key(docs.select(*own_columns)).join(verdicts, ["__t1", "__t2"]).withColumn("__copy", ~F.col(key).eqNullSafe(F.col("__first")))
    fed = rows.select(*own_columns, "__gone", "__copy")
    schema = T.StructType([*fed.schema.fields[:-2], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts, counts, removed = [], [], []
            for raw, gone, copy in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("__gone").to_pylist(), b.column("__copy").to_pylist()):
                lines = (raw or b"").split(b"\n")
                if copy:
                    out = [] if len(lines) >= params.min_lines else [x for x in lines if len(x.split()) < params.min_words]
                else:
                    drop = set(gone or ())
                    out = [x for i, x in enumerate(lines) if i not in drop] if drop else lines
                texts.append(b"\n".join(out))
                counts.append(len(lines))
                removed.append(len(lines) - len(out))
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([(new[f.name] if f.name in new else b.column(f.name)).cast(f.type) for f in target], schema=target)

    return fed.mapInArrow(run, schema)


def oracle(params: LineParams) -> str:
    """The same result in SQL, line by line, without ranks."""
    nexts = " || chr(10) || ".join(["line", *(f"lead(line, {k}) OVER w" for k in range(1, params.min_lines))])
    covered = " OR ".join(["coalesce(late, false)", *(f"coalesce(lag(late, {k}) OVER w, false)" for k in range(1, params.min_lines))])
    return f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
runs AS (SELECT *, {nexts} AS run,
    row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS seen,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
late AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS late FROM runs),
marked AS (SELECT doc_id, i, line, ({covered}) OR (seen AND words >= {params.min_words}) AS gone
  FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id"""
