"""Named query templates with a time span."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from .. import vocab
from ..operators.windows import Agg
from .continuous import ContinuousQuery, WindowSpec

# Fixed values of the named templates.
STEP_MS = 20
# The property's namespace belongs to the deployment: pass ``metric`` for another one.
BVP = "http://example.org/sensors/wearable.bvp"
PARTICIPANT_STREAM = "http://localhost:3000/dataset_participant{}/data/"
TEMPLATES = {
    "averageHRPatient1": ((1,), "averageHR1"),
    "averageHRPatient2": ((2,), "averageHR2"),
    "averageHRPatientMultiple": ((1, 2), "averageHR1"),
}


def named_query(name: str, start: datetime, end: datetime, step_ms: int = STEP_MS,
                stream: str = PARTICIPANT_STREAM, metric: str = BVP) -> ContinuousQuery | None:
    """The template over the span, or None for an unknown name."""
    if name not in TEMPLATES:
        return None
    participants, alias = TEMPLATES[name]
    span = int((end - start).total_seconds() * 1000)
    frames = tuple(WindowSpec(f"w{i + 1}", stream.format(p), span, step_ms) for i, p in enumerate(participants))
    body = tuple(p for w in frames for p in (
        (w.name, "?s", vocab.HAS_VALUE, "?o"), (w.name, "?s", vocab.RELATES_TO, metric)))
    return ContinuousQuery(name, frames, body, (Agg("avg", "o", alias),))


def run_named(name: str, observations: DataFrame, start: datetime, end: datetime, **options) -> DataFrame:
    query = named_query(name, start, end, **options)
    if query is None:
        raise KeyError(f"no template named {name}")
    return query.over_observations(observations)
