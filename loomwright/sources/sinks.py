"""Sinks: parquet, CSV, a PySpark script and a workspace's export with its manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from loomwright.errors import EngineError


def write_parquet(df: DataFrame, path: str) -> None:
    df.drop("_rid").write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.drop("_rid").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def script(space) -> str:
    """A PySpark program that replays the workspace."""
    return f'''"""Replays the workspace {space.name!r}."""
import json

from loomwright.plans.workspace import Workspace
from loomwright.session import get_spark

SPACE = Workspace.from_dict(json.loads({json.dumps(json.dumps(space.to_dict()))}))

if __name__ == "__main__":
    spark = get_spark()
    for role in SPACE.datasets:
        SPACE.frame(spark, role).write.parquet(f"out/{{role}}")
'''


def export(space, spark, folder: str, kind: str = "parquet") -> dict:
    """All roles, the fitted states and a manifest. Spark's committer makes each table whole or absent."""
    if kind not in ("parquet", "csv", "script", "pipeline"):
        raise EngineError(f"unknown export {kind!r}")
    inputs = {str(s.get("path")) for s in space.datasets.values() if isinstance(s, dict)}
    if folder in inputs:
        raise EngineError("an export can't overwrite its input")
    frames, states = space.replay(spark)
    manifest = {"name": space.name, "kind": kind, "steps": space.steps, "states": states, "files": []}
    for role, df in frames.items() if kind in ("parquet", "csv") else ():
        (write_parquet if kind == "parquet" else write_csv)(df, f"{folder}/{role}")
        manifest["files"].append(f"{folder}/{role}")
    if kind in ("script", "pipeline"):
        manifest["script"] = script(space)
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return manifest
