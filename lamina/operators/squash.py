"""The state of each image after all its layers: last write wins, markers remove.

Order is (layer_idx, entry_idx), whatever the layer: a marker removes what was written before it,
in its own layer too. Instead of a fold, each path's last write is compared with the latest marker
that hits it: `alive` if the write is later. Rows that a marker removed stay as shadows, since links
may still lead to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import paths


def decoded(entries: DataFrame) -> DataFrame:
    """Normalised paths and link targets (of hardlinks; symlink targets stay as they are), without
    empty paths and Meta records, with `action` and `victim` of markers."""
    path = paths.normalise(F.col("path"))
    target = F.when(F.col("kind") == "Hardlink", paths.normalise(F.col("link_target"))).otherwise(F.col("link_target"))
    out = entries.filter("kind <> 'Meta'").withColumns({"path": path, "link_target": target}).filter("path <> ''")
    action = paths.marker_action(F.col("path"))
    return out.withColumns({"action": action, "victim": F.when(action.isNotNull(), paths.marker_target(F.col("path")))})


def last_writes(rows: DataFrame) -> DataFrame:
    """The last ordinary entry of each path of each image. A maximum, so rows are combined before
    they move, and a path that every layer rewrites is no hot spot."""
    keys = ["image_id", "path"]
    order = ["layer_idx", "entry_idx"]
    rest = [c for c in rows.columns if c not in (*keys, *order, "action", "victim")]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    out = rows.filter("action is null").groupBy(*keys).agg(F.max(F.struct(*order)).alias("_seq"), best)
    return out.select(*keys, "_seq.*", "_row.*")


def marker_times(rows: DataFrame) -> DataFrame:
    """(image_id, victim, removed, cleared): the latest whiteout of a path and the latest opaque
    marker of a directory."""
    seq = F.struct("layer_idx", "entry_idx")
    when = lambda kind: F.max(F.when(F.col("action") == kind, seq))
    return rows.filter("action is not null").groupBy("image_id", "victim").agg(when("remove").alias("removed"), when("opaque").alias("cleared"))


def squash(entries: DataFrame) -> DataFrame:
    """One row for each path ever written in an image, its last entry, with `alive`."""
    rows = decoded(entries)
    return apply_markers(last_writes(rows), marker_times(rows))


def apply_markers(last: DataFrame, markers: DataFrame) -> DataFrame:
    """Last writes with `alive`: later than every marker that hits the path."""
    inner = markers.filter("victim <> ''")
    steps = last.select("image_id", "path", F.posexplode(paths.self_and_ancestors(F.col("path"))).alias("_up", "victim"))
    hits = steps.join(inner, ["image_id", "victim"]).groupBy("image_id", "path").agg(F.max(F.when(F.col("_up") == 0, F.col("removed")).otherwise(F.greatest("removed", "cleared"))).alias("_kill"))
    root = markers.filter("victim = ''").select("image_id", F.col("cleared").alias("_root"))  # a row an image at most
    out = last.join(hits, ["image_id", "path"], "left").join(root, "image_id", "left")
    alive = F.struct("layer_idx", "entry_idx") > F.greatest("_kill", "_root")
    return out.withColumn("alive", F.coalesce(alive, F.lit(True))).drop("_kill", "_root")


def live(squashed: DataFrame) -> DataFrame:
    return squashed.filter("alive").drop("alive")


def children_of_files(live_rows: DataFrame) -> DataFrame:
    """Live entries whose parent is live and no directory: a file may replace a directory without
    removing what is below it."""
    up = live_rows.select("image_id", F.col("path").alias("_p"), F.col("kind").alias("parent_kind"))
    below = live_rows.withColumn("_p", paths.parent(F.col("path")))
    return below.join(up, ["image_id", "_p"]).filter("parent_kind <> 'Directory'").drop("_p")
