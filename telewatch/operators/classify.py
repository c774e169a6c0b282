"""Derived risk views: contribution breakdown (R16) and the vote table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R


def contribution(latest: DataFrame) -> DataFrame:
    """Four rows per input row: CPU, Memory, Disk, Other; missing -> 0."""
    cpu = F.coalesce(F.col("cpu_percent"), F.lit(0.0))
    mem = F.coalesce(F.col("memory_percent"), F.lit(0.0))
    disk = F.coalesce(F.col("disk_write_mbps"), F.lit(0.0))
    parts = F.array(
        F.struct(F.lit("CPU").alias("component"), cpu.alias("contribution")),
        F.struct(F.lit("Memory").alias("component"), mem.alias("contribution")),
        F.struct(F.lit("Disk").alias("component"),
                 F.least(disk * F.lit(5.0), F.lit(100.0)).alias("contribution")),
        F.struct(F.lit("Other").alias("component"),
                 F.greatest(F.lit(100.0) - (cpu + mem) / F.lit(2.0), F.lit(0.0))
                 .alias("contribution")),
    )
    keep = [c for c in latest.columns]
    return latest.select(*keep, F.inline(parts))


def _f1_lookup():
    """Model F1 table keyed case-insensitively (ledger L17)."""
    pairs = []
    for name, f1 in R.MODEL_F1.items():
        pairs += [F.lit(name.strip().lower()), F.lit(f1)]
    return F.create_map(*pairs)


def vote_table(preds: DataFrame) -> DataFrame:
    """Explode the vote map; score = probability -> model F1 -> N/A.

    ``anomaly_count`` is the number of models voting 1 for the same prediction.
    """
    votes = F.from_json("models_json", "map<string,int>")
    probs = F.from_json("probabilities_json", "map<string,double>")
    # the anomaly count is per prediction: computed on its row before exploding
    exploded = preds.select("system_id", "id", "fault_type", probs.alias("_probs"),
                            F.size(F.map_filter(votes, lambda k, v: v == 1)).alias("anomaly_count"),
                            F.explode(votes).alias("model", "vote"))
    prob = F.col("_probs")[F.col("model")]
    f1 = _f1_lookup()[F.lower(F.trim(F.col("model")))]
    score = (F.when(prob.isNotNull(), F.concat(F.format_string("%.2f", prob * 100.0), F.lit("%")))
             .when(f1.isNotNull(), F.concat(F.format_string("%.2f", f1), F.lit("%")))
             .otherwise(F.lit("N/A")))
    reason = F.when(F.col("vote") == 1,
                    F.concat(F.lit("High "), F.col("fault_type"), F.lit(" anomaly detected"))) \
        .otherwise(F.lit("Normal operating pattern"))
    return exploded.select(
        "system_id", "id", "model",
        F.when(F.col("vote") == 1, "Anomaly").otherwise("Normal").alias("vote_label"),
        score.alias("score"), reason.alias("reason"), "anomaly_count")
