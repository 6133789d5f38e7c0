"""Settings of the geometry, the graph and a worker."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

METRICS = ("geodesic", "chordal")


@dataclass(frozen=True)
class SpaceConfig:
    """k neighbours span a tangent space of p dimensions; distance is one of METRICS."""

    k: int = 20
    p: int = 2
    distance: str = "geodesic"

    def __post_init__(self):
        if self.k <= 0 or self.p <= 0:
            raise ValueError("k and p must be positive")
        if self.distance not in METRICS:
            raise ValueError(f"unknown distance: {self.distance}")


@dataclass(frozen=True)
class GraphConfig:
    """Each entity links to k_graph others and is represented by at most max_chunks chunks."""

    k_graph: int = 3
    max_chunks: int = 5

    def __post_init__(self):
        if self.k_graph < 0 or self.max_chunks < 1:
            raise ValueError("k_graph must not be negative, max_chunks must be positive")


def wire_metric(name: str | None) -> str:
    """The metric that a request names: chordal, or geodesic for anything else."""
    return "chordal" if name == "chordal" else "geodesic"


def parse_broker_url(url: str) -> tuple[str, int]:
    """(host, port) of [tcp://]host[:port]; the port defaults to 1883."""
    host, _, port = url.removeprefix("tcp://").partition(":")
    return host, int(port) if port else 1883


@dataclass(frozen=True)
class WorkerConfig:
    broker: str
    job_id: str
    worker_id: str
    user: str
    password: str
    use_gpu: bool

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> WorkerConfig:
        """From environment variables; JOB_ID is required. use_gpu is kept for callers; Spark places the work."""
        env = os.environ if env is None else env
        job = env.get("JOB_ID", "")
        if not job:
            raise ValueError("JOB_ID is required")
        return cls(env.get("MQTT_BROKER", "tcp://localhost:1883"), job, env.get("WORKER_ID", f"worker-{job}"), env.get("MQTT_USER", ""), env.get("MQTT_PASSWORD", ""), env.get("USE_GPU", "").lower() in ("true", "1"))
