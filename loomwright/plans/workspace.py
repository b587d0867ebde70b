"""Workspaces: sources, a step log, and the plans that replay it.

A workspace is a JSON document. Each role (train, test) becomes one lazy plan; a fitted step adds the
aggregates of its fit. Steps are fitted on train where they touch it, else on their own role."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.analysis.joins import join_by_order, join_labels, merge_table
from loomwright.errors import EngineError, UnknownName
from loomwright.operators import get
from loomwright.operators.base import RID
from loomwright.operators.columns import RULES
from loomwright.operators.rows import condition, sort_keys
from loomwright.session import with_rid

TARGETS = ("train", "test", "both")
#: An offset from which a page is found by the rows' places.
DEEP = 10_000


@dataclass
class Workspace:
    name: str
    datasets: dict = field(default_factory=dict)
    label: dict | None = None
    merges: list = field(default_factory=list)
    steps: list = field(default_factory=list)
    #: Texts about columns, by their names in the raw frame.
    notes: dict = field(default_factory=dict)

    # -- documents --
    @classmethod
    def from_dict(cls, data: dict) -> Workspace:
        return cls(**data)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def open(cls, path: str) -> Workspace:
        with open(path) as f:
            return cls.from_dict(json.load(f))

    def save(self, path: str) -> None:
        """Whole or not at all."""
        folder = os.path.dirname(path) or "."
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
            json.dump(self.to_dict(), f, indent=1)
        os.replace(f.name, path)

    def add(self, op: str, params: dict | None = None, target: str = "both", note: str = "") -> Workspace:
        if target not in TARGETS:
            raise UnknownName("target", target, TARGETS)
        get(op).params(params)
        self.steps.append({"id": uuid.uuid4().hex[:8], "op": op, "target": target, "params": params or {}, "note": note})
        return self

    # -- plans --
    def raw(self, spark: SparkSession, role: str) -> DataFrame:
        from loomwright.sources.readers import load

        if role not in self.datasets:
            raise UnknownName("role", role, self.datasets)
        source = self.datasets[role]
        df = source if isinstance(source, DataFrame) else load(spark, source)
        df = df if RID in df.columns else with_rid(df)
        if self.label and self.label.get("source") and role == self.label.get("role", "train"):
            y = load(spark, self.label["source"]) if not isinstance(self.label["source"], DataFrame) else self.label["source"]
            df = join_labels(df, y.drop(RID), self.label["key"]) if self.label.get("key") else join_by_order(df, y, self.label.get("index"))
        for merge in self.merges:
            if merge.get("apply_to", "both") in (role, "both"):
                extra = merge["source"] if isinstance(merge["source"], DataFrame) else load(spark, merge["source"])
                df = merge_table(df, extra.drop(RID), merge["key"], merge.get("columns"))
        return df

    def replay(self, spark: SparkSession, version: int | None = None, roles=None) -> tuple[dict[str, DataFrame], list[dict]]:
        """({role: frame}, states) after the first `version` steps. A failing step is named."""
        steps = self.steps if version is None else self.steps[:version]
        roles = list(roles or self.datasets)
        wanted = set(roles)
        if any(s["target"] == "both" for s in steps) and "train" in self.datasets:
            wanted.add("train")
        frames = {r: self.raw(spark, r) for r in self.datasets if r in wanted}
        last_both = max((i for i, s in enumerate(steps) if s["target"] == "both"), default=-1)
        states = []
        for i, s in enumerate(steps):
            touched = [r for r in frames if s["target"] in (r, "both")]
            if "train" not in roles and i > last_both:
                touched = [r for r in touched if r != "train"]
            if not touched:
                states.append({})
                continue
            op = get(s["op"])
            try:
                fitted_on = "train" if "train" in touched else touched[0]
                state = op.fit(frames[fitted_on], s["params"])
                for r in touched:
                    frames[r] = op.apply(frames[r], s["params"], state)
            except EngineError as error:
                raise EngineError(f"step {i + 1} ({s['op']}): {error}") from error
            states.append(state)
        label = (self.label or {}).get("column")
        if (self.label or {}).get("last") and label:
            frames = {r: df.select(*[c for c in df.columns if c != label], label) if label in df.columns else df for r, df in frames.items()}
        return {r: frames[r] for r in roles}, states

    def frame(self, spark: SparkSession, role: str = "train", version: int | None = None) -> DataFrame:
        return self.replay(spark, version, [role])[0][role]


def column_notes(space: Workspace, spark: SparkSession, role: str = "train", version: int | None = None) -> dict:
    """notes under the columns' names after the first `version` steps, and keys: the raw name of each column that has another by then."""
    now = {c: c for c in space.raw(spark, role).columns if c != RID}
    for s in space.steps if version is None else space.steps[:version]:
        if s["target"] not in (role, "both"):
            continue
        p = s["params"]
        if s["op"] == "rename":
            now = {raw: p["mapping"].get(c, c) for raw, c in now.items()}
        elif s["op"] == "rename_columns_bulk":
            change = RULES[p.get("rule")]
            now = {raw: p.get("prefix", "") + change(c) + p.get("suffix", "") if not p.get("columns") or c in p["columns"] else c for raw, c in now.items()}
    return {"notes": {now[raw]: text for raw, text in space.notes.items() if raw in now}, "keys": {c: raw for raw, c in now.items() if c != raw}}


def page(df: DataFrame, offset: int = 0, limit: int = 100, columns=None, filters=(), combine="and", sort=(), ascending=True) -> DataFrame:
    """A page of rows: filter, sort (missing last), slice. A page near the head is a top-k; from DEEP on the rows are sorted in ranges and found by their place, so none are gathered on the driver."""
    for c in filters if combine == "and" else ():
        df = df.where(condition(df, c))
    if filters and combine == "or":
        hit = condition(df, filters[0])
        for c in filters[1:]:
            hit = hit | condition(df, c)
        df = df.where(hit)
    keys = sort_keys(df, list(sort), ascending) if sort else []
    df = df.orderBy(*keys, F.col(RID)) if RID in df.columns else df.orderBy(*keys) if keys else df
    if offset >= DEEP:
        place = F.col("__place")
        df = with_rid(df, "__place").where((place >= offset) & (place < offset + limit)).orderBy("__place").drop("__place")
    else:
        df = df.offset(offset).limit(limit)
    return df.select(*columns) if columns else df


def changes(before: DataFrame, after: DataFrame, most: int = 2000) -> DataFrame:
    """(_rid, column, before, after) of cells that differ, at most `most` (a preview)."""
    shared = [c for c in before.columns if c in after.columns and c != RID]
    text = lambda c: F.to_json(F.struct(F.col(f"`{c}`").alias("v")))
    old, new = (d.select(RID, F.array(*[text(c) for c in shared]).alias(k)) for d, k in ((before, "old"), (after, "new")))
    names = F.array(*[F.lit(c) for c in shared])
    joined = old.join(new, RID).select(RID, F.explode(F.arrays_zip(names.alias("column"), F.col("old").alias("before"), F.col("new").alias("after"))).alias("c")).select(RID, "c.*")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).orderBy(RID, "column").limit(most)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select(RID).join(after.select(RID), RID, "left_anti")


def preview(space: Workspace, spark: SparkSession, op: str, params: dict, role: str = "train") -> dict:
    """What one more step would do to a role: changed cells, removed rows, added and dropped columns."""
    before = space.frame(spark, role)
    train = space.frame(spark, "train") if "train" in space.datasets and role != "train" else before
    transform = get(op)
    after = transform.apply(before, params, transform.fit(train, params))
    return {"cells": changes(before, after), "removed": removed(before, after), "added": [c for c in after.columns if c not in before.columns], "dropped": [c for c in before.columns if c not in after.columns]}
