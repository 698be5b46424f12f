"""Audit trail rows (system, agent, tool) derived from investigations, appended with ``unionByName``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.decide import agent_trace


def audit_messages(inv: DataFrame) -> DataFrame:
    """investigation_id, seq, role, node_name, content for every investigation."""
    system = inv.select(
        "investigation_id", F.lit(-1).alias("seq"), F.lit("system").alias("role"), F.lit("webhook").alias("node_name"),
        F.concat(F.lit("Investigation "), F.col("investigation_id"), F.lit(" opened for drift event "),
                 F.col("event_id"), F.lit(". Severity changed from "), F.col("previous_severity"), F.lit(" to "),
                 F.col("new_severity"), F.lit(".")).alias("content"))
    trace = agent_trace(inv).select("investigation_id", "seq", "role", "node_name", "content")
    tool = inv.where(F.col("action.queue_job_required")).select(
        "investigation_id", F.lit(100).alias("seq"), F.lit("tool").alias("role"), F.lit("queue").alias("node_name"),
        F.concat(F.lit("Queued job "), F.col("action.recommended_action")).alias("content"))
    return system.unionByName(trace).unionByName(tool)
