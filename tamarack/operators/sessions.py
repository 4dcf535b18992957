"""Clips of a session: merging, consecutive de-duplication, deletion, input guard; zips of model outputs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.text import strip


def consecutive(clips: DataFrame, session: str, order: list[str], clip_id: str, event_time: str | None = None, idle: timedelta = timedelta(hours=1)) -> DataFrame:
    """clips whose id differs from that of the clip before it in the session; with event_time, also those that come more than ``idle`` after it."""
    before = F.lag(F.struct(F.col(clip_id).alias("id"), *([F.col(event_time).alias("at")] if event_time else []))).over(Window.partitionBy(session).orderBy(*order))
    marked = clips.withColumn("_before", before)
    kept = ~F.col("_before.id").eqNullSafe(F.col(clip_id)) | F.col("_before.id").isNull()
    if event_time:
        kept |= F.col(event_time) > F.col("_before.at") + F.lit(idle)
    return marked.filter(kept).drop("_before")


def append(live: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Live and uploaded clips in one table; live ones have no filename."""
    return live.withColumn("source", F.lit("live")).unionByName(uploaded.withColumn("source", F.lit("upload")), allowMissingColumns=True)


def with_ids(clips: DataFrame, clip_id: str = "id") -> DataFrame:
    """clips with a random UUID where they have no id yet."""
    new = F.expr("uuid()")
    return clips.withColumn(clip_id, F.coalesce(F.col(clip_id), new) if clip_id in clips.columns else new)


def delete(clips: DataFrame, gone: DataFrame, clip_id: str = "id") -> DataFrame:
    return clips.join(gone.select(clip_id).distinct(), clip_id, "left_anti")


def merge_texts(requests: DataFrame, clips: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """(session, user_text, merged): the stripped user text and the clips' texts in order, by lines, stripped."""
    spoken = clips.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("_spoken"))
    joined = requests.join(spoken, session, "left")
    return joined.select(session, "user_text", F.when(F.col("_spoken").isNull(), strip(F.col("user_text"))).otherwise(strip(F.concat(strip(F.col("user_text")), F.lit("\n"), "_spoken"))).alias("merged"))


def has_input(n_clips: Column, text: Column, has_image: Column) -> Column:
    """Whether there is any clip, text (blank text counts) or image."""
    return (F.coalesce(n_clips, F.lit(0)) > 0) | (F.coalesce(text, F.lit("")) != "") | F.coalesce(has_image, F.lit(False))


def zip_shorter(a: Column, b: Column) -> Column:
    """Pairs of the elements of a and b, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("box"), F.slice(b, F.lit(1), n).alias("text"))


def int_polygon(points: Column) -> Column:
    return F.transform(points, lambda p: F.transform(p, lambda x: x.cast("int")))
