"""Lodestone: retrieval and repository-history analytics on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path


def reach(spark) -> None:
    """Let Python workers import this package from where the driver has it.

    Clusters install the package on their nodes; this is for a checkout that is only on
    the driver's ``sys.path``.
    """
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *known])
