"""Proofs: stacks put together again are the images that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = ["kind", "mode", "uid", "gid", "size", "content_hash", "link_target", "rdev_major", "rdev_minor", "xattrs"]


def reapplied(layers: DataFrame, stacks: DataFrame) -> DataFrame:
    """What each image's stack makes: the last layer that has a path wins."""
    rest = [c for c in layers.columns if c not in ("m", "path", "image_id")]
    rows = layers.drop("image_id").join(stacks, "m")
    return rows.groupBy("image_id", "path").agg(F.max_by(F.struct(*rest), "position").alias("_row")).select("image_id", "path", "_row.*")


def differences(left: DataFrame, right: DataFrame, fields: list[str] = COMPARED) -> DataFrame:
    """(image_id, path, reason): paths on one side only, and the fields in which others differ."""
    a = left.select("image_id", "path", F.struct(*fields).alias("a"))
    b = right.select("image_id", "path", F.struct(*fields).alias("b"))
    both = a.join(b, ["image_id", "path"], "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    reason = F.when(F.col("a").isNull(), "only right").when(F.col("b").isNull(), "only left").when(F.size(changed) > 0, F.array_join(changed, ","))
    return both.select("image_id", "path", reason.alias("reason")).filter("reason is not null")


def link_groups(rows: DataFrame) -> DataFrame:
    """(image_id, terminal, members): files with the names that are linked to them."""
    from lamina.operators.links import chains

    ends = chains(rows).filter("fault is null")
    return ends.groupBy("image_id", "terminal").agg(F.array_sort(F.collect_set("path")).alias("members"))


def digest_mismatches(observed: DataFrame) -> DataFrame:
    """Rows (…, digest, observed) whose digests differ."""
    return observed.filter("digest <> observed")


def manifest_faults(layers: DataFrame, stacks: DataFrame, diff_ids: DataFrame) -> DataFrame:
    """(image_id, fault): layers (m, digest) against stacks (image_id, position, m) and the digests
    (image_id, position, diff_id) that documents list."""
    expected = stacks.join(layers.select("m", "digest"), "m", "left")
    both = expected.join(diff_ids, ["image_id", "position"], "full")
    fault = F.when(F.col("m").isNull(), "a digest without a layer").when(F.col("diff_id").isNull(), "a layer without a digest").when(F.col("digest").isNull(), "a layer that was not written").when(F.col("digest") != F.col("diff_id"), "another digest")
    return both.select("image_id", "position", fault.alias("fault")).filter("fault is not null")
