"""A session over one folder of tables: the questions of the engine as methods, each a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.paths import below, depth
from strataframe.operators import changes, diff, duplicates, entries, hierarchy, history, orphans, relations, selection, series, structure
from strataframe.sources.tables import table


class UnknownSnapshot(ValueError):
    """No counted snapshot has the id."""


class PairError(ValueError):
    """The snapshots can't be compared: equal, or the base isn't before the target."""


@dataclass
class Session:
    """Reads the tables of ``folder``. Nothing runs before a result is used."""

    spark: SparkSession
    folder: str
    _cache: dict = field(default_factory=dict)

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def series(self) -> DataFrame:
        return series.snapshot_series(self._table("snapshots"))

    @cached_property
    def entries(self) -> DataFrame:
        return entries.counted_entries(self._table("snapshot_entries"), self.series)

    @cached_property
    def placed(self) -> DataFrame:
        return series.placed_identities(self._table("document_identities"), self._table("snapshot_entries"), self.series)

    def snapshot(self, snapshot_id: str) -> DataFrame:
        """Entries of one snapshot; an unknown id is an error."""
        if self.series.where(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise UnknownSnapshot(snapshot_id)
        return self.entries.where(F.col("snapshot_id") == snapshot_id)

    def listing(self, snapshot_id: str, prefix: str | None = None, object_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        rows = self.snapshot(snapshot_id).where(below(F.col("relative_path"), prefix))
        if object_type is not None:
            rows = rows.where(F.col("object_type") == object_type)
        return selection.page(rows, [F.col("scope_id"), F.col("relative_path")], limit, offset)

    def structure(self, snapshot_id: str, max_depth: int | None = None) -> DataFrame:
        """Sizes of directories. The depth is cut after the sums are made."""
        nodes = structure.structure(self.snapshot(snapshot_id))
        return nodes if max_depth is None else nodes.where(depth(F.col("path")) <= max_depth)

    def _pair(self, base: str, target: str) -> tuple[DataFrame, DataFrame]:
        places = {r["snapshot_id"]: (r["series"], r["pos"]) for r in self.series.where(F.col("snapshot_id").isin(base, target)).select("snapshot_id", "series", "pos").collect()}
        for x in (base, target):
            if x not in places:
                raise UnknownSnapshot(x)
        if base == target or (places[base][0] == places[target][0] and places[base][1] > places[target][1]):
            raise PairError(f"{base}, {target}")
        at = lambda x: self.entries.where(F.col("snapshot_id") == x).withColumn("pair", F.lit(target))
        return at(base), at(target)

    def diff(self, base: str, target: str) -> DataFrame:
        return diff.snapshot_diff(*self._pair(base, target))

    def growth(self, base: str, target: str) -> DataFrame:
        return structure.growth_nodes(structure.growth(*self._pair(base, target)))

    def relations(self, base: str, target: str) -> DataFrame:
        return relations.same_location(*self._pair(base, target))

    def transitions(self, base: str, target: str) -> DataFrame:
        return relations.transitions(*self._pair(base, target))

    def duplicates(self, snapshot_id: str) -> DataFrame:
        return duplicates.payload_groups(self.snapshot(snapshot_id))

    def history(self) -> DataFrame:
        return history.location_history(self.placed, self.series)

    def changes(self) -> DataFrame:
        return changes.location_changes(self.placed, self.series)

    def hierarchy(self, paths: bool = False) -> DataFrame:
        return hierarchy.resolve(hierarchy.tree_nodes(self._table("content_matches"), "document_key", "node_id", "parent"), paths)

    def orphans(self) -> DataFrame:
        parents = orphans.parent_keys(self._table("snapshots"), "snapshot_id")
        return orphans.orphan_references(self._table("snapshot_entries"), "snapshot_entries", "entry_id", "snapshot_id", parents)
