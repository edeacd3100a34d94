"""Named queries over the driver's tables, and the same in SQL for comparison.

Sets are rendered as text ("0,2"), counts are 64-bit, and every computed column has a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import paths, scalars
from lamina.lineage import cut
from lamina.operators import compact, identity, links, membership, partition, report, squash, stack, verify
from lamina.plans import adapters

#: The threshold, in bytes, of the query that dissolves small layers.
THRESHOLD = 500_000


def _set(m: str | Column = "m") -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.array_join(m.cast("array<string>"), ",")


def _squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squash.squash(adapters.change_log(spark, sf_dir))


def _signed(live: DataFrame) -> DataFrame:
    return membership.with_signature(identity.with_identity(live))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.order_tree(spark, sf_dir)


def _tree_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(cut(_tree(spark, sf_dir)))


def _layers(live: DataFrame) -> DataFrame:
    return partition.backfill(cut(partition.subset_layers(_signed(live))), live)


def squash_last_write(spark, sf_dir):
    out = squash.live(squash.squash(adapters.turns(spark, sf_dir)))
    return out.select("image_id", "path", "entry_idx", "size", "content_hash")


def squash_with_tombstones(spark, sf_dir):
    return squash.live(_squashed(spark, sf_dir)).select("image_id", "path", "kind", "mode", "size", "layer_idx", "entry_idx")


def shadow_rows(spark, sf_dir):
    return _squashed(spark, sf_dir).filter("not alive").select("image_id", "path", "kind", "layer_idx", "entry_idx")


def children_of_files(spark, sf_dir):
    """With the folders of mode 1 written as files."""
    rows = adapters.change_log(spark, sf_dir).withColumn("kind", F.when(F.col("mode") == 1, "Regular").otherwise(F.col("kind")))
    return squash.children_of_files(squash.live(squash.squash(rows))).select("image_id", "path", "parent_kind")


def squash_without_meta(spark, sf_dir):
    """With every other file of size 50 and more written as a record that is no entry."""
    meta = (F.col("kind") == "Regular") & (F.col("size") >= 50) & (F.col("entry_idx") % 2 == 0)
    rows = adapters.change_log(spark, sf_dir).withColumn("kind", F.when(meta, "Meta").otherwise(F.col("kind")))
    return squash.live(squash.squash(rows)).select("image_id", "path", "kind", "size", "entry_idx")


def mode_bits(spark, sf_dir):
    mode = (F.col("c_custkey") * 37 % 4096).cast("int")
    rows = adapters.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", *[scalars.has_bits(mode, bits).alias(name) for name, bits in (("set_uid", 0o4000), ("set_gid", 0o2000), ("sticky", 0o1000), ("all_read", 0o444))], scalars.octal(mode).alias("octal"))


def marker_decode(spark, sf_dir):
    rows = squash.decoded(adapters.change_log(spark, sf_dir))
    return rows.filter("action is not null").groupBy("image_id", "action", "victim").agg(F.count("*").alias("n"))


def path_normalise(spark, sf_dir):
    raw = F.col("raw")
    p = paths.normalise(raw)
    return adapters.page_paths(spark, sf_dir).select("page_id", p.alias("path"), paths.basename(p).alias("base"), paths.parent(p).alias("folder"), paths.depth(p).cast("long").alias("depth"))


def path_prefixes(spark, sf_dir):
    rows = adapters.page_paths(spark, sf_dir).select("page_id", paths.normalise(F.col("raw")).alias("path"))
    return rows.select("page_id", F.posexplode(paths.strict_ancestors(F.col("path"))).alias("up", "ancestor")).groupBy("ancestor").agg(F.count("*").alias("n"), F.max("up").cast("long").alias("farthest"))


def path_order(spark, sf_dir):
    """The neighbour before each path, within a scheme and host, in the order of components."""
    from pyspark.sql import Window

    p = paths.normalise(F.col("raw"))
    rows = adapters.page_paths(spark, sf_dir).select("image_id", p.alias("path")).distinct().withColumn("host", F.split("path", "/")[0])
    order = Window.partitionBy("image_id", "host").orderBy(paths.components(F.col("path")))
    return rows.select("image_id", "path", F.lag("path").over(order).alias("before"))


def link_closure(spark, sf_dir):
    rows = squash.squash(adapters.link_log(spark, sf_dir))
    return links.resolve(rows, strict=False).filter("kind = 'Hardlink' or fault is not null").select("image_id", "path", "link_target", "fault")


def link_demotion(spark, sf_dir):
    rows = squash.squash(adapters.link_log(spark, sf_dir))
    was = rows.filter("alive and kind = 'Hardlink'").select("image_id", "path")
    out = links.resolve(rows, strict=False).join(was, ["image_id", "path"], "left_semi")
    return out.filter("kind = 'Regular'").select("image_id", "path", "mode", "size", "layer_idx", "entry_idx")


def identity_key(spark, sf_dir):
    return identity.with_identity(adapters.texts(spark, sf_dir)).select(F.col("entry_idx").alias("doc_id"), "ident")


def naive_membership(spark, sf_dir):
    rows = squash.live(squash.squash(adapters.texts(spark, sf_dir)))
    return membership.naive(identity.with_identity(rows)).groupBy(_set().alias("images")).agg(F.count("*").alias("n_entries"))


def effective_membership(spark, sf_dir):
    return membership.effective(_signed(_tree(spark, sf_dir))).groupBy(_set().alias("images")).agg(F.count("*").alias("n_classes"))


def effective_membership_log(spark, sf_dir):
    return membership.effective(_signed(squash.live(_squashed(spark, sf_dir)))).groupBy(_set().alias("images")).agg(F.count("*").alias("n_classes"))


def subset_layers(spark, sf_dir):
    return partition.subset_layers(_signed(_tree(spark, sf_dir))).select(_set().alias("images"), "path", "kind", "mode", "size", "image_id")


def ancestor_backfill(spark, sf_dir):
    return _tree_layers(spark, sf_dir).select(_set().alias("images"), "path", "kind", "mode", "size", "image_id")


def ancestor_completeness(spark, sf_dir):
    """The invariant: no layer lacks an ancestor."""
    return partition.missing_ancestors(_tree_layers(spark, sf_dir)).agg(F.count("*").alias("missing"))


def layer_size_estimate(spark, sf_dir):
    return compact.estimated_sizes(_tree_layers(spark, sf_dir)).select(_set().alias("images"), "n_entries", "bytes")


def size_estimate_texts(spark, sf_dir):
    rows = adapters.texts(spark, sf_dir)
    return rows.groupBy("image_id").agg((F.lit(compact.TRAILER) + F.sum(compact.entry_bytes())).cast("long").alias("bytes"))


def dissolve_small_layers(spark, sf_dir):
    live = cut(_tree(spark, sf_dir))
    out = compact.dissolve(_layers(live), live, THRESHOLD)
    return out.select(_set().alias("images"), "path", "kind", "mode", "size", "image_id")


def layer_stack(spark, sf_dir):
    return stack.stacks(_tree_layers(spark, sf_dir).select("m")).select("image_id", "position", _set().alias("images"))


def dedup_summary(spark, sf_dir):
    out = report.totals(compact.estimated_sizes(_tree_layers(spark, sf_dir)))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


def layer_labels(spark, sf_dir):
    return report.layer_labels(report.layer_rows(_tree_layers(spark, sf_dir))).select("label", "bytes", "vs_naive")


def set_algebra(spark, sf_dir):
    sets = compact.estimated_sizes(_tree_layers(spark, sf_dir)).select("m")
    a, b = sets.select(F.col("m").alias("a"), F.explode("m").alias("i")), sets.select(F.col("m").alias("b"), F.explode("m").alias("i"))
    pairs = a.join(b, "i").select("a", "b").distinct()
    return pairs.select(_set("a").alias("a"), _set("b").alias("b"), _set(membership.intersect(F.col("a"), F.col("b"))).alias("both"), membership.is_subset(F.col("a"), F.col("b")).alias("within"), _set(membership.insert(F.col("a"), F.lit(7))).alias("with_7"))


def needed_sources(spark, sf_dir):
    return report.needed_sources(squash.live(squash.squash(adapters.parts(spark, sf_dir)))).select("image_id", "layer_idx")


def squash_volume(spark, sf_dir):
    """The last write of each part, counted by image and layer."""
    out = squash.live(squash.squash(adapters.parts(spark, sf_dir)))
    return out.groupBy("image_id", "layer_idx").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def input_accounting(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "documents")
    images = rows.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("repo_tags")).select(F.col("source").alias("image_id"), "repo_tags")
    return report.input_rows(images, rows.select(F.col("source").alias("image_id"), F.col("n_chars").alias("size")))


def platform_divergence(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "documents").select(F.col("lang").alias("architecture"), F.lit("linux").alias("os"), F.when(F.col("doc_id") % 2 == 0, F.lit("v8")).alias("variant"))
    return report.platform_divergence(rows)


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults of known places: some are lost, moved, or have another mode or size."""
    n = F.octet_length("path") + F.col("image_id")
    rows = rows.filter(n % 11 != 0).withColumns({"mode": F.when((n % 11).isin(1, 3), F.col("mode") + 1).otherwise(F.col("mode")), "size": F.when((n % 11).isin(2, 3), F.col("size") + 1).otherwise(F.col("size"))})
    return rows.withColumn("path", F.when(n % 11 == 4, F.concat("path", F.lit("~"))).otherwise(F.col("path")))


def roundtrip_diff(spark, sf_dir):
    """Layers put together again and then damaged, against the images: the damage and nothing else."""
    live = cut(_tree(spark, sf_dir))
    layers = compact.dissolve(_layers(live), live, THRESHOLD)
    again = verify.reapplied(layers, stack.stacks(layers.select("m")))
    return verify.differences(live, _damaged(again))


def roundtrip_log(spark, sf_dir):
    """The same for the change log, whose images lack some parents."""
    live = cut(squash.live(_squashed(spark, sf_dir)))
    layers = cut(_layers(live))
    again = verify.reapplied(layers, stack.stacks(layers.select("m")))
    return verify.differences(live, _damaged(again))


def t0_format(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return rows.select("event_id", scalars.rfc3339(F.col("t") * ((F.col("event_id") % 7 - 3) * 60)).alias("created"))


def scalar_sizes(spark, sf_dir):
    n = F.col("c_custkey")
    text = F.concat(n.cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", "Mi", "g", "x"))), (n % 5 + 1).cast("int")))
    rows = adapters.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", scalars.size_bytes(text).cast("long").alias("bytes"), scalars.ceil_block(n).alias("blocks"), scalars.record_length(n).cast("long").alias("record"), scalars.permille(n, n * 3 + 1).alias("permille"), scalars.short_digest(F.concat(F.lit("sha256:"), F.sha2(n.cast("string"), 256))).alias("digest"))


def queries() -> dict:
    names = [k for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql")]
    return {k: globals()[k] for k in names}


def oracle_sql() -> dict[str, str]:
    from lamina.oracles import ORACLES

    return dict(ORACLES)
