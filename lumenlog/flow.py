"""Flows: the frames, scorers and outputs of an analysis by name, with a registry for own ones.

A scorer has ``fit`` (marked summaries, models so far, settings -> tables of its model) and ``score`` (messages, models, settings -> messages with more
columns). Framers map messages to intervals, outputs take scored messages and intervals. Settings are dataclass fields: an unknown key or
a value of another type is an error.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import clusters, context, scoring, training
from lumenlog.sources import files

Models = dict[str, DataFrame]


class Scorer(Protocol):
    """What a scorer class has; ``after`` names the scorers whose results it reads."""

    after: tuple[str, ...]

    def fit(self, summaries: DataFrame, models: Models, length: int) -> Models: ...

    def score(self, messages: DataFrame, models: Models, length: int) -> DataFrame: ...


SCORERS: dict[str, type] = {}
FRAMERS: dict[str, Callable[..., DataFrame]] = {}
OUTPUTS: dict[str, Callable[..., None]] = {}


def register(kind: dict[str, object], name: str) -> Callable[[object], object]:
    """Decorator that adds a scorer class, a framer or an output under a name; a name is given once."""

    def add(made: object) -> object:
        if name in kind:
            raise ValueError(f"{name} is registered already")
        kind[name] = made
        return made

    return add


def settings(cls: type, values: dict[str, object]) -> object:
    """An instance of a settings dataclass; every key must be a field, and of the field's type."""
    known = {f.name: f for f in dataclasses.fields(cls)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"unknown settings of {cls.__name__}: {unknown}")
    for key, value in values.items():
        default = known[key].default
        if default is not dataclasses.MISSING and default is not None and not isinstance(value, (type(default), int) if isinstance(default, float) else type(default)):
            raise ValueError(f"{cls.__name__}.{key} must be {type(default).__name__}")
    return cls(**values)


@register(SCORERS, "clusters")
@dataclass(frozen=True)
class Clusters:
    """Status of ids in context of the clusters of information."""

    fraction: float = 0.3
    ratio: float = 0.5
    restarts: int = 50
    after: tuple[str, ...] = ()

    def fit(self, summaries: DataFrame, models: Models, length: int) -> Models:
        pairs = training.mutual_information(summaries, length).select("a", "b", "mi")
        found = clusters.information_clusters(pairs, self.restarts)
        kept = clusters.kept_clusters(found, pairs, self.ratio).select("cluster")
        return {"labels": found.join(kept, "cluster", "left_semi").select("message_id", "cluster"), "known": summaries.select("message_id").distinct()}

    def score(self, messages: DataFrame, models: Models, length: int) -> DataFrame:
        return context.context_status(messages, models["labels"], models["known"], self.fraction).withColumn("inside", F.col("status") == "IN_CONTEXT")


@register(SCORERS, "rarity")
@dataclass(frozen=True)
class Rarity:
    after: tuple[str, ...] = ("clusters",)

    def fit(self, summaries: DataFrame, models: Models, length: int) -> Models:
        inside = "inside" if "inside" in summaries.columns else None
        return {"rarity": training.bernoulli_full(summaries, length, inside), "span": training.n_intervals(summaries, length)}

    def score(self, messages: DataFrame, models: Models, length: int) -> DataFrame:
        n = models["span"].select(F.col("n_intervals")).scalar()
        return scoring.rarity_scores(messages.withColumn("all_n", n), models["rarity"], F.col("all_n")).drop("all_n")


@register(SCORERS, "count")
@dataclass(frozen=True)
class Count:
    after: tuple[str, ...] = ("clusters",)

    def fit(self, summaries: DataFrame, models: Models, length: int) -> Models:
        return {"count": training.log_normal(summaries, "inside" if "inside" in summaries.columns else None)}

    def score(self, messages: DataFrame, models: Models, length: int) -> DataFrame:
        return scoring.count_scores(messages, models["count"])


@register(SCORERS, "periodicity")
@dataclass(frozen=True)
class Periodicity:
    points: int = 10
    after: tuple[str, ...] = ()

    def fit(self, summaries: DataFrame, models: Models, length: int) -> Models:
        return {"periodicity": context.periodicity_model(context.last_seen(summaries, length), self.points)}

    def score(self, messages: DataFrame, models: Models, length: int) -> DataFrame:
        seen = context.last_seen_scores(context.last_seen(messages.select("source_id", "frame", "message_id", "ticks"), length), models["periodicity"])
        return messages.join(seen.select("source_id", "frame", "message_id", F.col("status").alias("last_seen"), "given_last", "last_ms"), ["source_id", "frame", "message_id"], "left")


@register(SCORERS, "weighted")
@dataclass(frozen=True)
class Weighted:
    """The message's final score; weights by severity, as a JSON object of numbers, are 1 unless given."""

    weights: str = "{}"
    after: tuple[str, ...] = ("rarity", "count")

    def fit(self, summaries: DataFrame, models: Models, length: int) -> Models:
        return {}

    def score(self, messages: DataFrame, models: Models, length: int) -> DataFrame:
        weights = {int(k): float(v) for k, v in json.loads(self.weights).items()}
        weight = scoring.severity_weight(F.col("severity"), weights) if "severity" in messages.columns else F.lit(1.0)
        explained = F.coalesce(F.col("status") == "IN_CONTEXT", F.lit(False)) if "status" in messages.columns else None
        return messages.withColumn("anomaly", scoring.weighted(F.col("count_score"), F.col("rarity"), weight, explained))


@register(FRAMERS, "tumbling")
def tumbling(messages: DataFrame, length: int) -> DataFrame:
    return training.message_summaries(messages, length)


@dataclass(frozen=True)
class Step:
    """A scorer in a flow under its registered name."""

    name: str
    settings: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    """Fine frames are stored, coarse ones (a multiple) are trained on and scored."""

    fine_ms: int = 600_000
    coarse_ms: int = 3_600_000
    framer: str = "tumbling"
    scorers: tuple[Step, ...] = (Step("clusters"), Step("rarity"), Step("count"), Step("periodicity"), Step("weighted"))
    outputs: tuple[str, ...] = ("results", "xml")

    def checked(self) -> list[tuple[str, Scorer]]:
        """Scorers in the order of their dependencies; unknown names, settings and cycles are errors."""
        if self.coarse_ms % self.fine_ms:
            raise ValueError("coarse frames must be a multiple of the fine ones")
        for name, kind in ((self.framer, FRAMERS), *[(o, OUTPUTS) for o in self.outputs]):
            if name not in kind:
                raise ValueError(f"unknown: {name}")
        made: dict[str, Scorer] = {}
        for step in self.scorers:
            if step.name not in SCORERS:
                raise ValueError(f"unknown scorer {step.name}")
            made[step.name] = settings(SCORERS[step.name], step.settings)
        order = scoring.ordered({n: {a for a in s.after if a in made} for n, s in made.items()})
        return [(n, made[n]) for n in order]


def flow_of(group: str | None, flows: dict[str, Flow], default: Flow) -> Flow:
    """The flow that a group's sources take, by name without case; the default for other groups."""
    return {k.lower(): f for k, f in flows.items()}.get((group or "").lower(), default)


def load(spark: SparkSession, path: str) -> Flow:
    """A flow of a JSON file: fine_ms, coarse_ms, framer, scorers (name and settings), outputs; unknown keys are errors."""
    data = json.loads(files.read_text(spark, path))
    if "scorers" in data:
        data["scorers"] = tuple(settings(Step, s) for s in data["scorers"])
    if "outputs" in data:
        data["outputs"] = tuple(data["outputs"])
    flow = settings(Flow, data)
    flow.checked()
    return flow


def fit(summaries: DataFrame, flow: Flow) -> Models:
    """Models of all scorers, each trained on the summaries as those before it leave them.

    Model tables are small and used many times, so they are kept in memory; the caller drops them with ``unpersist``."""
    models: Models = {}
    marked = summaries
    for _, scorer in flow.checked():
        models |= {name: table.persist() for name, table in scorer.fit(marked, models, flow.coarse_ms).items()}
        if "labels" in models and "inside" not in marked.columns:
            marked = scorer.score(marked, models, flow.coarse_ms).drop("cluster", "status")
    scored = score(summaries, models, flow)
    totals = scoring.interval_scores(scored)
    return models | {"percentiles": training.percentile_table(totals.where("n_ids > 0"), "score")}


def score(summaries: DataFrame, models: Models, flow: Flow) -> DataFrame:
    for _, scorer in flow.checked():
        summaries = scorer.score(summaries, models, flow.coarse_ms)
    return summaries


def score_intervals(messages: DataFrame, models: Models, least: float = 0.0) -> DataFrame:
    """(source_id, frame, score, n_ids, anomaly, log_prob) by the stored percentile table."""
    totals = scoring.interval_scores(messages)
    return scoring.final_interval_scores(totals.join(scoring.percentile_rank(totals, table=models["percentiles"]).select("source_id", "frame", "rank"), ["source_id", "frame"]), least).drop("rank")
