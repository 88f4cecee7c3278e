"""Clusters of detections whose span is limited, by Spark's recursive query: no Python, no group in a worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: One level of the recursion cuts a cluster at its largest gap, and at all others as large, from left to right
#: while what is left still spans too much. Largest gaps shrink from level to level.
_SPLIT = """
WITH RECURSIVE cuts (utt, t, most) MAX RECURSION LEVEL {levels} AS (
  SELECT utt, t, most FROM {first}
  UNION ALL
  SELECT utt, piece.t, piece.most FROM (
    SELECT utt, explode(transform(arrays_zip(array_prepend(starts, 0), array_append(starts, size(t))),
      x -> named_struct('t', slice(t, x['0'] + 1, x['1'] - x['0']), 'most', slice(most, x['0'] + 1, x['1'] - x['0'])))) AS piece FROM (
      SELECT utt, t, most, aggregate(
        filter(sequence(1, size(t) - 1), i -> t[i] - t[i - 1] = array_max(gaps)),
        named_struct('at', 0, 'going', true, 'starts', cast(array() AS array<int>)),
        (a, i) -> if(a.going AND t[size(t) - 1] - t[a.at] > most[a.at],
          named_struct('at', i, 'going', true, 'starts', array_append(a.starts, i)),
          named_struct('at', a.at, 'going', false, 'starts', a.starts)),
        a -> a.starts) AS starts FROM (
        SELECT utt, t, most, transform(sequence(1, size(t) - 1), i -> t[i] - t[i - 1]) AS gaps
        FROM cuts WHERE size(t) > 1 AND t[size(t) - 1] - t[0] > most[0]))))
SELECT utt, t FROM cuts WHERE size(t) = 1 OR t[size(t) - 1] - t[0] <= most[0]
"""


def split_clusters(detections: DataFrame, levels: int = 1000) -> DataFrame:
    """(utt, c_start, c_end, n) of detections (utt, frame, gap, most), one a frame.

    Detections part where the next is `gap` or more frames away, by the earlier one's gap. Then clusters from
    whose first to last frame it is more than `most`, by the first detection's, part at their largest gap, the
    first of equals, until none does. A level cuts at one size of gap, so there are at most as many levels as
    sizes of gaps; more than `levels` is an error. Rows in a recursion are limited by
    spark.sql.cteRecursionRowLimit, which a session with more clusters than that raises (-1: none)."""
    w = W.partitionBy("utt").orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(w) >= F.lag("gap").over(w)).cast("int"), F.lit(0))
    rows = detections.withColumn("_new", new).withColumn("_cid", F.sum("_new").over(w))
    held = F.array_sort(F.collect_list(F.struct("frame", "most")))  # one cluster's detections
    first = rows.groupBy("utt", "_cid").agg(held.alias("_h")).select("utt", F.col("_h.frame").alias("t"), F.col("_h.most").cast("array<double>").alias("most"))
    out = detections.sparkSession.sql(_SPLIT.replace("{levels}", str(int(levels))), first=first)
    return out.select("utt", F.get("t", F.lit(0)).alias("c_start"), (F.element_at("t", -1) + 1).alias("c_end"), F.size("t").cast("long").alias("n"))


def split_by_length(detections: DataFrame, lengths: DataFrame, share: float = 1.5) -> DataFrame:
    """split_clusters() of detections (utt, frame, comp) by the lengths (comp, len) of their components' templates:
    the gap is the earlier detection's length, the most that a cluster spans `share` times its first's."""
    rows = detections.join(lengths.select("comp", "len"), "comp")
    return split_clusters(rows.select("utt", "frame", F.col("len").alias("gap"), (F.col("len") * F.lit(float(share))).alias("most")))
