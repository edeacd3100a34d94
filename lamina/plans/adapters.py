"""The driver's tables as entry tables (FIXTURES.md, part 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.schema import entries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, from events: an image for each residue of the user, a layer for each day; errors are
    whiteouts, signups opaque markers, clicks directories, views and purchases files."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    top = _text("t", F.floor(user / 4) % 5)
    folder = F.concat(top, F.lit("/"), _text("u", F.floor(user / 20) % 6))
    file = _text("f", k % 4)
    kind = F.col("event_type")
    path = (
        F.when(kind == "error", F.concat(folder, F.lit("/.wh."), file))
        .when(kind == "signup", F.concat(folder, F.lit("/.wh..wh..opq")))
        .when(kind == "click", F.when(k % 5 == 0, top).otherwise(folder))
        .otherwise(F.concat(folder, F.lit("/"), file))
    )
    return entries(
        table(spark, sf_dir, "events"),
        image_id=user % 4,
        layer_idx=F.datediff(F.to_date("ts"), F.lit("2024-01-01")),
        entry_idx=F.col("event_id"),
        path=path,
        kind=F.when(kind == "click", "Directory").otherwise("Regular"),
        mode=k % 2,
        size=F.when(kind.isin("view", "purchase"), k * 10).otherwise(0),
    )


def link_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with links: views whose k is a multiple of 3 are hardlinks to a neighbour."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = change_log(spark, sf_dir)
    views = table(spark, sf_dir, "events").filter("event_type = 'view'").filter(k % 3 == 0)
    user = F.col("user_id")
    target = F.concat(_text("t", F.floor(user / 4) % 5), F.lit("/"), _text("u", F.floor(user / 20) % 6), F.lit("/"), _text("f", F.floor(k / 4) % 6))
    links = views.select(F.col("event_id").alias("entry_idx"), target.alias("_target"))
    out = rows.join(links, "entry_idx", "left")
    linked = F.col("_target").isNotNull()
    return out.withColumns({"kind": F.when(linked, "Hardlink").otherwise(F.col("kind")), "link_target": F.col("_target"), "size": F.when(linked, 0).otherwise(F.col("size"))}).select(*rows.columns)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, from documents: an image for each source, files named and told apart by contents."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    return entries(table(spark, sf_dir, "documents"), image_id=F.regexp_extract("source", "([0-9]+)$", 1), layer_idx=F.lit(0), entry_idx=F.col("doc_id"), path=digest, kind=F.lit("Regular"), size=F.octet_length(text), content_hash=digest)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, from conversations: a layer for each turn, a path for each role."""
    return entries(table(spark, sf_dir, "conversations"), image_id=F.col("conv_id"), layer_idx=F.col("turn"), entry_idx=F.col("turn"), path=F.col("role"), kind=F.lit("Regular"), size=F.octet_length("text"), content_hash=F.sha2("text", 256))


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, from orders: an image for each order status; regions and nations are directories,
    customers files. Already squashed."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    per_customer = table(spark, sf_dir, "orders").groupBy(status.alias("image_id"), F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    files = per_customer.join(customer, "c_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    levels = files.groupBy("image_id", "r_name", "n_name", "c_custkey").agg(F.sum("n").alias("n"))
    levels = levels.rollup("image_id", "r_name", "n_name", "c_custkey").agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).filter("g in (0, 1, 3)")
    return entries(
        levels,
        image_id=F.col("image_id"),
        layer_idx=F.lit(0),
        entry_idx=F.lit(0),
        path=F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string")),
        kind=F.when(F.col("g") == 0, "Regular").otherwise("Directory"),
        mode=F.when(F.col("g") == 0, F.col("n") % 3).when(F.col("g") == 1, F.col("n") % 2).otherwise(0),
        size=F.when(F.col("g") == 0, 700 * (F.col("c_custkey") % 5)).otherwise(0),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, from lineitem and part: an image for each return flag, a layer for each line number."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    image = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    path = F.concat_ws("/", "p_brand", "p_type", F.col("l_partkey").cast("string"))
    return entries(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), image_id=image, layer_idx=F.col("l_linenumber"), entry_idx=F.col("l_orderkey") * 100 + F.col("l_quantity"), path=path, kind=F.lit("Regular"), size=F.col("l_quantity").cast("long") * 10)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, from pages: page_id, image (1 for https) and host and path of the address, with a slash
    before and after some to be normalised."""
    bare = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("./"), bare)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), bare, F.lit("//"))).otherwise(bare)
    return table(spark, sf_dir, "pages").select("page_id", F.startswith(F.col("url"), F.lit("https")).cast("int").alias("image_id"), raw.alias("raw"))
