"""Detection-shaped views over the general test tables.

One SQL text per view, readable py Spark and py the checking engine; only the integer division
operator differs between the two.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_GT = """
SELECT event_id AS gt_id, event_id {div} 50 AS case_id, event_id {div} 100 AS patient_id,
       (event_id {div} 5) % 2 AS label, 2 + (event_id {div} 5) % 4 AS grade,
       (event_id {div} 5) % 7 <> 0 AS supervised, (event_id {div} 5) % 11 = 0 AS ignore,
       CAST((event_id * 37) % 23 AS DOUBLE) AS x1,
       CAST((event_id * 53) % 19 AS DOUBLE) AS y1,
       CAST((event_id * 37) % 23 + 6 + (event_id {div} 5) % 3 AS DOUBLE) AS x2,
       CAST((event_id * 53) % 19 + 6 + (event_id {div} 5) % 4 AS DOUBLE) AS y2,
       CAST((event_id * 11) % 9 AS DOUBLE) AS z1,
       CAST((event_id * 11) % 9 + 4 AS DOUBLE) AS z2
FROM events WHERE event_id % 5 = 0 AND (event_id {div} 50) % 4 <> 3
"""

_DET_BASE = """
SELECT event_id, value, event_id - event_id % 5 AS b,
       (event_id {div} 5 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 2 AS label
FROM events WHERE event_id % 5 <> 0
"""

_DET = """
SELECT event_id AS det_id, event_id {div} 50 AS case_id, event_id {div} 100 AS patient_id, label,
       value / 500.0e0 AS score,
       CAST(px AS DOUBLE) AS x1, CAST(py AS DOUBLE) AS y1,
       CAST(px + 7 AS DOUBLE) AS x2, CAST(py + 7 AS DOUBLE) AS y2,
       CAST(pz AS DOUBLE) AS z1, CAST(pz + 4 AS DOUBLE) AS z2,
       event_id % 3 AS model, (event_id {div} 7) % 4 AS tile_id,
       CAST(1 + (event_id * 2) % 11 AS DOUBLE) / ptotal AS p2,
       CAST(1 + (event_id * 3) % 11 AS DOUBLE) / ptotal AS p3,
       CAST(1 + (event_id * 4) % 11 AS DOUBLE) / ptotal AS p4,
       CAST(1 + (event_id * 5) % 11 AS DOUBLE) / ptotal AS p5
FROM (SELECT *, (b * 37) % 23 + (event_id * 7) % 9 - 4 + CASE WHEN event_id % 13 = 0 THEN 100 ELSE 0 END AS px,
             (b * 53) % 19 + (event_id * 3) % 7 - 3 AS py,
             (b * 11) % 9 + event_id % 3 - 1 AS pz,
             CAST(4 + (event_id * 2) % 11 + (event_id * 3) % 11 + (event_id * 4) % 11
                  + (event_id * 5) % 11 AS DOUBLE) AS ptotal
      FROM det_base)
"""

_CASES = """
SELECT case_id, min(patient_id) AS patient_id,
       CAST(40 + case_id % 7 AS DOUBLE) AS shape_x, CAST(36 + case_id % 5 AS DOUBLE) AS shape_y,
       CAST(18 + case_id % 3 AS DOUBLE) AS shape_z,
       0.5e0 + (case_id % 4) * 0.25e0 AS sp_x, 0.5e0 + (case_id % 3) * 0.25e0 AS sp_y,
       3.0e0 + (case_id % 2) * 0.6e0 AS sp_z
FROM (SELECT event_id {div} 50 AS case_id, event_id {div} 100 AS patient_id FROM events)
GROUP BY case_id
"""

VIEWS = {"gt": _GT, "det_base": _DET_BASE, "det": _DET, "cases": _CASES}
NEEDS = {"det": ("det_base",), "voxels": ("gt",)}

VOXELS_DUCK = """
SELECT case_id, gt_id, label, grade, z, y, x,
       CAST((x * 7 + y * 5 + z * 3 + case_id) % 101 AS DOUBLE) AS value
FROM (SELECT case_id, gt_id, label, grade,
             unnest(range(CAST(z1 AS BIGINT), CAST(z2 AS BIGINT))) AS z, x1, x2, y1, y2 FROM gt) a,
     LATERAL (SELECT unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y) b,
     LATERAL (SELECT unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x) c
"""


def duck_views(*names: str) -> str:
    """Common table expressions defining the named views for the checking engine."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for dep in NEEDS.get(n, ()):
            visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    text = {k: v.format(div="//") for k, v in VIEWS.items()} | {"voxels": VOXELS_DUCK}
    return ", ".join(f"{n} AS ({text[n]})" for n in ordered)


#: Events whose boxes make one partition of voxels, some 0.7 million.
EVENTS_A_PARTITION = 20_000


class Tables:
    """The supplied tables plus the derived views, loaded lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str, source: str, frame: DataFrame) -> DataFrame:
        text = VIEWS[name].format(div="DIV").replace(f"FROM {source}", "FROM {src}")
        return self.spark.sql(text, src=frame)

    @cached_property
    def gt(self) -> DataFrame:
        return self._view("gt", "events", self("events"))

    def det_of(self, events: DataFrame) -> DataFrame:
        """Detections of any events table, streaming ones included."""
        return self._view("det", "det_base", self._view("det_base", "events", events))

    @cached_property
    def det(self) -> DataFrame:
        return self.det_of(self("events"))

    @cached_property
    def cases(self) -> DataFrame:
        return self._view("cases", "events", self("events"))

    @cached_property
    def boxes(self) -> DataFrame:
        """``gt`` dealt out by case, in partitions whose number grows with the events."""
        parts = max(
            int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism,
            -(-self("events").count() // EVENTS_A_PARTITION),
        )
        return self.gt.repartition(parts, "case_id")

    @cached_property
    def voxels(self) -> DataFrame:
        """One row per voxel of each box, dealt out by case like ``boxes``.

        Joins and groups whose keys hold the case need no further shuffle of voxels. Spark takes the table to be as small
        as the boxes, so the hint keeps it from being broadcast.
        """
        axis = "explode(sequence(CAST({0}1 AS BIGINT), CAST({0}2 AS BIGINT) - 1)) AS {0}"
        df = self.boxes.hint("merge")
        keep = ["case_id", "gt_id", "label", "grade"]
        df = df.selectExpr(*keep, "x1", "x2", "y1", "y2", axis.format("z"))
        df = df.selectExpr(*keep, "x1", "x2", "z", axis.format("y"))
        df = df.selectExpr(*keep, "z", "y", axis.format("x"))
        return df.selectExpr("*", "CAST((x * 7 + y * 5 + z * 3 + case_id) % 101 AS DOUBLE) AS value")
