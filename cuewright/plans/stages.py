"""The steps of a run that are data work, as named DataFrame stages over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import drop_invalid_times
from ..operators import timeline as L

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A step with the tables that it needs, and the function that gives the table named like the stage."""

    step_id: int
    name: str
    needs: tuple[str, ...]
    run: Callable[[Tables], DataFrame]


def pipeline_stage(step_id: int, name: str, *needs: str):
    """Makes a stage of a function from tables to a table."""
    return lambda fn: Stage(step_id, name, needs, fn)


@pipeline_stage(0, "clean_cues", "cues")
def clean_cues(t: Tables) -> DataFrame:
    """Cues cleaned for speech: the first piece of each text, empty texts kept, numbered by start."""
    rows = drop_invalid_times(t["cues"]).withColumn("r", T.process_text(F.col("text"), "sentence", 300))
    return rows.withColumn("text", F.coalesce(F.get("r.segments", F.lit(0)), F.lit(""))).drop("r")


@pipeline_stage(3, "requests", "clean_cues", "references")
def requests(t: Tables) -> DataFrame:
    return L.synth_requests(t["clean_cues"], t["references"])


@pipeline_stage(4, "timeline", "clean_cues", "clips")
def timeline(t: Tables) -> DataFrame:
    return L.playout_timeline(t["clean_cues"], t["clips"])


@pipeline_stage(5, "aligned_cues", "timeline", "clean_cues")
def aligned_cues(t: Tables) -> DataFrame:
    return L.align_texts(t["timeline"], t["clean_cues"])


@pipeline_stage(6, "speed_plan", "clean_cues", "aligned_cues", "media")
def speed(t: Tables) -> DataFrame:
    played = t["aligned_cues"].groupBy("media_id").agg(F.max("end_us").alias("duration_us"))
    return L.speed_analysis(t["clean_cues"], t["aligned_cues"], t["media"], played)


@pipeline_stage(7, "mux", "media", "timeline")
def mux(t: Tables) -> DataFrame:
    return L.mux_plan(t["media"], L.timeline_summary(t["timeline"]))


STAGES = [clean_cues, requests, timeline, aligned_cues, speed, mux]


def text_pipeline(rows: DataFrame, fn: Callable[[str], str | list[str] | None], column: str = "text") -> DataFrame:
    """The other columns with piece_no, piece and error: a row for each piece that a user's own function makes of a text, in Arrow batches.

    The function gives a text, a list of any number of them, or None for none. Where it fails, one row tells of the error; a null text is not
    passed on and gives one row without a piece.
    """
    names = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[int, int | None, str | None, str | None]] = []
            for i, text in enumerate(batch.column(column).to_pylist()):
                if text is None:
                    made.append((i, None, None, None))
                    continue
                try:
                    found = fn(text)
                    pieces = [] if found is None else [found] if isinstance(found, str) else list(found)
                except Exception as error:  # noqa: BLE001
                    made.append((i, None, None, f"{type(error).__name__}: {error}"))
                else:
                    made += [(i, n, piece, None) for n, piece in enumerate(pieces)]
            at, numbers, pieces, errors = (list(c) for c in zip(*made, strict=True)) if made else ([], [], [], [])
            columns = [*(batch.column(c).take(pa.array(at, pa.int64())) for c in names), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "piece_no", "piece", "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != column)
    return rows.mapInArrow(run, f"{fields}piece_no int, piece string, error string")


def run_stages(tables: Tables, stages: list[Stage] = STAGES) -> Tables:
    """All stages in order; a stage whose tables aren't there is an error that names them."""
    out = dict(tables)
    for stage in stages:
        if missing := [n for n in stage.needs if n not in out]:
            raise KeyError(f"{stage.name} needs {', '.join(missing)}")
        out[stage.name] = stage.run(out)
    return out
