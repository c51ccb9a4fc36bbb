"""Quality states of entities: an ordered fold over trigger events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers
from ..schema import QUALITY_STATE_SCORE, QUALITY_TRANSITIONS

STATES = list(QUALITY_STATE_SCORE)
BLOCK = 65_536


def step_map(trigger: Column) -> Column:
    """Where each state goes under a trigger, as an array of state positions.

    A trigger that is not valid in a state leaves it unchanged.
    """
    cells = []
    for i, state in enumerate(STATES):
        out = F.lit(i)
        for source, name, target in QUALITY_TRANSITIONS:
            if source == state:
                out = F.when(trigger == name, STATES.index(target)).otherwise(out)
        cells.append(out)
    return F.array(*cells)


def _compose(parts: Column) -> Column:
    """One map from an ordered array of (position, map) structs."""
    start = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(parts, start, lambda acc, p: F.transform(acc, lambda s: F.get(p["m"], s)))


def transition_maps(triggers: DataFrame, order: str = "ts", tiebreak: str = "event_id", levels: int = 3, block: int = BLOCK) -> DataFrame:
    """The combined state map of every entity: ``entity, m, triggers``.

    State maps compose associatively, so ordered runs of at most ``block`` triggers are
    folded side by side and their results folded again, level by level; an entity with
    most of the events is spread over many tasks.
    """
    numbered = row_numbers(triggers, ["entity"], order, tiebreak)
    cells = numbered.select("entity", (F.col("rn") - 1).alias("pos"), step_map(F.col("trigger")).alias("m"), F.lit(1).cast("long").alias("n"))
    for _ in range(levels):
        cells = (
            cells.groupBy("entity", F.floor(F.col("pos") / block).alias("b"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("parts"), F.sum("n").alias("n"))  # at most `block` entries
            .select("entity", F.col("b").alias("pos"), _compose(F.col("parts")).alias("m"), "n")
        )
    return cells.select("entity", "m", F.col("n").alias("triggers"))


def apply_maps(maps: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """New state per entity from its old one (``entity, state``; COMPLETE where unknown)."""
    names = F.array(*[F.lit(s) for s in STATES])
    if states is None:
        df = maps.withColumn("state", F.lit("COMPLETE")).withColumn("known", F.lit(True))
    else:
        df = states.select("entity", "state").join(maps, "entity", "full").withColumn("state", F.coalesce("state", F.lit("COMPLETE")))
    before = (F.array_position(names, F.col("state")) - 1).cast("int")
    after = F.coalesce(F.get("m", before), before)
    return df.select("entity", F.get(names, after).alias("state"), F.coalesce("triggers", F.lit(0)).cast("long").alias("triggers"))


def quality_states(triggers: DataFrame, **options) -> DataFrame:
    """Final state and score of each entity from (entity, trigger, ts, event_id) rows."""
    out = apply_maps(transition_maps(triggers, **options))
    score = F
    for name, value in QUALITY_STATE_SCORE.items():
        score = score.when(F.col("state") == name, value)
    return out.withColumn("score", score.otherwise(0.0))
