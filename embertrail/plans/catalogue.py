"""The engine's query catalogue: name -> (query, SQL or None)."""

from __future__ import annotations

from embertrail.plans import q_frames, q_legs, q_objects, q_space, q_telemetry

ALL = q_objects.QUERIES | q_frames.QUERIES | q_telemetry.QUERIES | q_space.QUERIES | q_legs.QUERIES


def queries():
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
