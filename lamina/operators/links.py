"""Hardlinks: chains are followed through live and shadow rows by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.errors import MalformedInputError
from lamina.lineage import cut
from lamina.schema import PAYLOAD

#: What can be wrong with a chain.
FAULTS = ("no target", "cycle", "missing", "not a regular file")


def chains(rows: DataFrame) -> DataFrame:
    """(image_id, path, terminal, fault): where the chain of each hardlink of `rows` ends, the
    last name before it stops being a hardlink. Every step doubles the length that is covered, so
    the number of joins is the logarithm of the longest chain; what still moves after twice as many
    hops as there are links goes round in a circle."""
    edges = rows.filter("kind = 'Hardlink'").select("image_id", "path", F.coalesce("link_target", F.lit("")).alias("terminal"))
    state = cut(edges.withColumn("_moves", F.lit(True)))
    hops, links = 1, state.count()
    while links and hops <= 2 * links and not state.filter("_moves").isEmpty():
        ahead = state.select("image_id", F.col("path").alias("terminal"), F.col("terminal").alias("_next"))
        state = cut(state.join(ahead, ["image_id", "terminal"], "left").select("image_id", "path", F.coalesce("_next", "terminal").alias("terminal"), F.col("_next").isNotNull().alias("_moves")))
        hops *= 2
    ends = rows.select("image_id", F.col("path").alias("terminal"), F.col("kind").alias("_kind"))
    found = state.join(ends, ["image_id", "terminal"], "left")
    fault = F.when(F.col("terminal") == "", FAULTS[0]).when(F.col("_kind") == "Hardlink", FAULTS[1]).when(F.col("_kind").isNull(), FAULTS[2]).when(F.col("_kind") != "Regular", FAULTS[3])
    return found.select("image_id", "path", "terminal", fault.alias("fault"))


def resolve(squashed: DataFrame, strict: bool = True) -> DataFrame:
    """The live rows with links settled. A hardlink whose direct target is live stays; any other
    becomes a copy of the file at the end of its chain, with that file's metadata and place of the
    body. Malformed chains raise an error, or with strict=False stay and are marked in `fault`."""
    live_rows = squashed.filter("alive")
    links = live_rows.filter("kind = 'Hardlink'")
    targets = live_rows.select("image_id", F.col("path").alias("link_target"))
    broken = links.join(targets, ["image_id", "link_target"], "left_anti").select("image_id", "path")
    ends = chains(squashed).join(broken, ["image_id", "path"], "left_semi")
    if strict and (bad := ends.filter("fault is not null").orderBy("image_id", "path").first()):
        raise MalformedInputError(f"hardlink {bad['path']} of image {bad['image_id']}: {bad['fault']}")
    taken = ["layer_idx", "entry_idx", *PAYLOAD]
    files = squashed.filter("kind = 'Regular'").select("image_id", F.col("path").alias("terminal"), *[F.col(c).alias(f"_t_{c}") for c in taken])
    copies = ends.join(files, ["image_id", "terminal"], "left").withColumn("_demoted", F.col("fault").isNull())
    out = live_rows.join(copies, ["image_id", "path"], "left")
    demoted = F.coalesce("_demoted", F.lit(False))
    columns = [F.when(demoted, F.col(f"_t_{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in squashed.columns if c != "alive"]
    return out.select(*columns, *([] if strict else [F.col("fault")]))


def colocate(layers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Layers (m, path, entry) whose private layers hold the file behind each of their hardlinks:
    links point at the end of their chain, and that file is added where it is missing."""
    ends = chains(resolved).filter("fault is null").select(F.col("image_id").alias("_i"), "path", "terminal")
    single = (F.size("m") == 1) & (F.col("kind") == "Hardlink")
    marked = layers.withColumn("_i", F.when(single, F.col("m")[0])).join(ends, ["_i", "path"], "left")
    rewritten = marked.withColumn("link_target", F.coalesce("terminal", "link_target")).select(*layers.columns)
    wanted = marked.filter("terminal is not null").select("m", F.col("_i").alias("image_id"), F.col("terminal").alias("path")).distinct()
    missing = wanted.join(layers.select("m", "path"), ["m", "path"], "left_anti")
    added = missing.join(resolved, ["image_id", "path"]).select(*layers.columns)
    return rewritten.unionByName(added)
