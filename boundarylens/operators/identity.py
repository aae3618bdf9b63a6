"""Whether two runs saw the same artifact; caches are in operators/caches.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_artifact(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """producers: run_id, artifact_id, digest, payload. consumers: consumer_id, run_id (of the run that triggered it), artifact_id, digest, payload.

    One row per consumer whose trigger is known, with a verdict for each attribute; nulls equal nulls.
    """
    p = producers.select("run_id", *[F.col(c).alias(f"p_{c}") for c in ("artifact_id", "digest", "payload")])
    same = {c: F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("artifact_id", "digest", "payload")}
    return consumers.join(p, "run_id").select(
        "consumer_id", "run_id", *[v.alias(f"same_{k}") for k, v in same.items()], (same["artifact_id"] & same["digest"] & same["payload"]).alias("same_object")
    )


def payload_digest(payload: Column) -> Column:
    """Of the payload as a line."""
    return F.sha2(F.concat(payload, F.lit("\n")), 256)
