"""Late-tolerant persistence of known sources as keyed state.

Each source keeps the distinct observation days of clusters that can still
change. A cluster is final when the watermark has passed its anchor by more
than the gap; its days then leave the state, so state per source is bounded by
the gap plus the allowed lateness, not by history.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.greedy import candidate_members, summarise_candidates
from ..session import drop_folder, materialize

OUTPUT = "source string, anchor_day int, n_dates int, confirmed boolean, final boolean"
STATE = "days array<int>"


def walk_days(days: list[int], gap: int) -> list[tuple[int, int]]:
    """(anchor, distinct days) of the first-fit clusters of sorted days."""
    out: list[tuple[int, int]] = []
    for d in days:
        if out and d - out[-1][0] <= gap:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((d, 1))
    return out


def persist_stream(stream: DataFrame, gap_days: int = 3, min_passes: int = 2, lateness: str = "3 days") -> DataFrame:
    """Updates ``source, anchor_day, n_dates, confirmed, final`` from ``source, ts``."""

    def step(key, frames, state):
        days = set(state.get[0]) if state.exists else set()
        for pdf in frames:
            days.update(int(d) for d in pdf["day"].unique())
        mark = state.getCurrentWatermarkMs() // 86_400_000
        clusters = walk_days(sorted(days), gap_days)
        done = [a for a, _ in clusters if a + gap_days < mark]
        rows = [(key[0], a, n, n >= min_passes, a + gap_days < mark) for a, n in clusters]
        last = max(done) + gap_days if done else None
        rest = sorted(d for d in days if last is None or d > last)
        if rest:
            state.update((rest,))
            state.setTimeoutTimestamp(max((rest[0] + gap_days + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["source", "anchor_day", "n_dates", "confirmed", "final"])

    dated = stream.withWatermark("ts", lateness).select("source", "ts", F.unix_date(F.to_date("ts")).alias("day"))
    return dated.groupBy("source").applyInPandasWithState(
        step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def latest(updates: DataFrame) -> DataFrame:
    """Current view of an update log with a ``batch`` column."""
    newest = F.max_by(F.struct("n_dates", "confirmed"), F.struct("batch", "n_dates"))
    return updates.groupBy("source", "anchor_day").agg(newest.alias("v")).select("source", "anchor_day", "v.*")


CANDIDATE = "id string, date date, lon double, lat double, score double, source_pass_ids array<string>"
CLUSTER = "candidate_id string, n_members bigint, n_dates bigint, score double, det_date date, lon double, lat double, source_pass_ids array<string>, confirmed boolean"


def start_position_persistence(
    stream: DataFrame, target: str, checkpoint: str, *, min_passes: int = 2, gap_days: int = 3, radius_km: float = 25.0, late_days: int = 10,
):
    """Persistence by place of a stream of candidates (``CANDIDATE``), batch by batch.

    The watermark is the latest day seen less ``late_days``. A batch clusters the
    candidates that are open with the new ones, over space blocks; a cluster is
    final once the watermark has passed its anchor by more than the gap, as
    nothing that may still come can change it, and its members leave the state.
    So the state holds the gap and the lateness, not history. Rows behind the
    watermark go to a side table, which is not part of the result.

    Every batch writes its own folders and reads those of the batch before, so a
    retried batch is not doubled; older states are deleted.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        rows = batch.select(*[c.split(" ")[0] for c in CANDIDATE.split(", ")])
        day = F.unix_date("date")
        if batch_id:
            mark = spark.read.schema("mark int").json(f"{target}/mark/b={batch_id - 1}").first()["mark"]
            rows.where(day < mark).write.mode("overwrite").parquet(f"{target}/late/b={batch_id}")
            rows = rows.where(day >= mark).unionByName(spark.read.schema(CANDIDATE).parquet(f"{target}/state/b={batch_id - 1}"))
        rows = materialize(rows, "open-candidates")
        top = rows.agg(F.max(day)).first()[0]
        mark = max(x for x in (mark, None if top is None else top - late_days, -(1 << 31)) if x is not None)
        members, heads = candidate_members(rows, gap_days, radius_km)
        # Read by the counts, the passes and the state; else each joins all candidates with their anchors again.
        members = materialize(members, "members")
        heads = materialize(heads.withColumn("final", F.unix_date("det_date") + gap_days < mark), "heads")
        clusters = materialize(summarise_candidates(members, heads.drop("final"), min_passes), "clusters")
        final = heads.select("candidate_id", "final")
        for name, keep in (("final", F.col("final")), ("open", ~F.col("final"))):
            clusters.join(final.where(keep).select("candidate_id"), "candidate_id", "left_semi").write.mode("overwrite").parquet(f"{target}/{name}/b={batch_id}")
        waits = members.join(final.where("not final").select(F.col("candidate_id").alias("anchor_id")), "anchor_id", "left_semi")
        waits.select(*rows.columns).write.mode("overwrite").parquet(f"{target}/state/b={batch_id}")
        spark.createDataFrame([(mark,)], "mark int").coalesce(1).write.mode("overwrite").json(f"{target}/mark/b={batch_id}")
        for name in ("state", "open"):
            drop_folder(spark, f"{target}/{name}/b={batch_id - 2}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_positions(spark: SparkSession, target: str) -> DataFrame:
    """Final clusters and those still open, as of the newest batch."""
    final = spark.read.schema(CLUSTER).parquet(f"{target}/final").drop("b")
    open_ = spark.read.schema(CLUSTER + ", b long").parquet(f"{target}/open")
    # The newest batch is told by the marks, also where it has no open cluster.
    last = spark.read.schema("mark int, b long").json(f"{target}/mark").agg(F.max("b").alias("b"))
    return final.unionByName(open_.join(F.broadcast(last), "b", "left_semi").drop("b"))
