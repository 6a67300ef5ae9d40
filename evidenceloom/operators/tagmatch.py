"""How well an event's tags answer desired concepts, from tag confidence and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenceloom.functions.similarity import cosine, relatedness

MAX_DESIRED, SUPPORTS, MAX_JOINT, JOINT_WEIGHT = 8, 2, 3, 0.1


def match(tags: DataFrame, concepts: DataFrame, n_concepts: int, event: str = "event_id") -> DataFrame:
    """event, coverage, and match of each event with a tag.

    tags: event, name, confidence, vector (null if there is none). concepts: concept (0, 1, ...; -1 is the phrase of all of them), name,
    vector; at most MAX_DESIRED and that phrase, so the small side is broadcast. A tag supports a concept with its
    confidence times relatedness (1 for the same name, 0 without a vector); a concept's score is its best support if there is one concept,
    else the mean of its two best ones, and at least the confidence of an exact tag. Coverage is the harmonic
    mean, 0 if one concept has none; two or three concepts give a tenth to the joint phrase.
    """
    if not 1 <= n_concepts <= MAX_DESIRED:
        raise ValueError(f"1 to {MAX_DESIRED} concepts")
    few = concepts.select(F.col("concept"), F.col("name").alias("c_name"), F.col("vector").alias("c_vector")).limit(MAX_DESIRED + 2)
    if few.count() > MAX_DESIRED + 1:
        raise ValueError(f"at most {MAX_DESIRED} concepts and their phrase")
    c = F.broadcast(few)
    same = F.col("name") == F.col("c_name")
    related = F.when(same, 1.0).when(F.col("vector").isNull() | F.col("c_vector").isNull(), 0.0).otherwise(relatedness(cosine(F.col("vector"), F.col("c_vector"))))
    scored = tags.join(c).select(event, "concept", (F.col("confidence") * related).alias("s"), F.when(same, F.col("confidence")).otherwise(0.0).alias("exact"))
    k = 1 if n_concepts == 1 else SUPPORTS
    w = Window.partitionBy(event, "concept").orderBy(F.col("s").desc())
    best = scored.withColumns({"n": F.row_number().over(w), "exact": F.max("exact").over(Window.partitionBy(event, "concept"))}).where(F.col("n") <= k)
    each = best.groupBy(event, "concept").agg(F.greatest(F.avg("s"), F.max("exact")).alias("x"))
    own, joint = F.col("concept") >= 0, F.max(F.when(F.col("concept") < 0, F.col("x")))
    found = each.groupBy(event).agg(F.min(F.when(own, F.col("x"))).alias("least"), F.sum(F.when(own & (F.col("x") > 0), 1 / F.col("x"))).alias("inverse"), joint.alias("joint"))
    coverage = F.when(F.col("least") > 0, F.lit(float(n_concepts)) / F.col("inverse")).otherwise(0.0)
    out = found.select(event, coverage.alias("coverage"), F.coalesce("joint", F.lit(0.0)).alias("joint"))
    total = F.col("coverage") if not 2 <= n_concepts <= MAX_JOINT else (1 - JOINT_WEIGHT) * F.col("coverage") + JOINT_WEIGHT * F.least("coverage", "joint")
    return out.select(event, "coverage", total.alias("match"))
