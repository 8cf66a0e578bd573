"""Contact paths: every touch of an entity, in order, from several facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_accents, safe_div
from ..functions.scale import ordered_rank

# Result texts that mean the contact worked, column names that
# announce a channel, and the size of a channel list.
EFFECTIVE = ("realizada", "realizado", "efectiva", "efectivo", "abierto", "abierta", "click", "clic",
             "completada", "completado", "atendida", "atendido", "done", "opened", "clicked")
CHANNEL_NAMES = ("channel", "canal", "medio", "via", "medium")
MAX_CHANNELS = 12
NO_RESULT = "no result"


def deepest_flag(df: DataFrame, flags: Sequence[str], out: str = "result") -> DataFrame:
    """Name of the rarest 0/1 flag that is on: how far the contact got."""
    counts = df.agg(*[F.count_if(F.col(f) == 1).alias(f) for f in flags]).first()
    order = sorted(flags, key=lambda f: (counts[f], f))
    reached = F.coalesce(*[F.when(F.col(f) == 1, F.lit(f)) for f in order], F.lit(NO_RESULT))
    return df.withColumn(out, reached)


def pick_channel(df: DataFrame, state: str | None = None) -> str | None:
    """The named channel column, else the text column with fewest (2..12) values."""
    texts = [n for n, t in df.dtypes if t == "string" and n != state]
    for n in texts:
        if any(c in n.lower() for c in CHANNEL_NAMES):
            return n
    if not texts:
        return None
    row = df.agg(*[F.approx_count_distinct(n).alias(str(i)) for i, n in enumerate(texts)]).first()
    # the sketch only rules out what is far beyond; the few that are left are counted exactly
    near = [n for i, n in enumerate(texts) if row[i] <= 2 * MAX_CHANNELS]
    if not near:
        return None
    exact = df.agg(*[F.count_distinct(n).alias(n) for n in near]).first()
    fits = [(exact[n], n) for n in near if 1 < exact[n] <= MAX_CHANNELS]
    return min(fits)[1] if fits else None


def contact_path(facts: Mapping[str, Mapping], entity: str = "entity") -> DataFrame:
    """One row per contact with its order inside the entity.

    Each fact gives `df`, `entity`, `date`, `id` and optionally `channel` and
    `result` columns.  Order is by date, then id; a very active entity is
    numbered in pieces, never in a single task.
    """
    if len(facts) < 2:
        raise ValueError("a path needs at least two contact facts")
    parts = []
    for name, f in facts.items():
        channel = F.col(f["channel"]).cast("string") if f.get("channel") else F.lit(name)
        result = F.col(f["result"]).cast("string") if f.get("result") else F.lit(NO_RESULT)
        parts.append(
            f["df"].select(
                F.col(f["entity"]).alias(entity), F.col(f["date"]).alias("contact_at"), F.col(f["id"]).alias("contact_id"),
                F.lit(name).alias("type"), channel.alias("channel"), result.alias("result"),
            )
        )
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    return ordered_rank(events, "contact_at", "contact_id", [entity], out="contact_order", total="entity_contacts")


def is_effective(result: str | Column) -> Column:
    return fold_accents(result).rlike("|".join(EFFECTIVE))


def path_measures(path: DataFrame, entity: str = "entity") -> DataFrame:
    """Contacts, contacts per entity, longest path, effective and effectiveness."""
    per_entity = path.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_effective("result")).alias("e")
    )
    return per_entity.agg(
        F.sum("n").alias("contacts"),
        safe_div(F.sum("n"), F.count(F.lit(1))).alias("contacts_per_entity"),
        F.max("n").alias("longest_path"),
        F.sum("e").alias("effective"),
        safe_div(F.sum("e"), F.sum("n")).alias("effectiveness"),
    )
