import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lamina import catalog
from lamina.errors import MalformedInputError
from lamina.functions import paths, scalars
from lamina.operators import compact, identity, links, membership, partition, report, squash, stack, verify
from lamina.schema import ENTRIES, entries
from lamina.streaming.incremental import squash_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark, rows):
    """Entries from (image, layer, entry, path, kind[, mode, size, hash, target])."""
    full = [(*r, *[None] * (9 - len(r))) for r in rows]
    df = spark.createDataFrame(full, "i int, l int, e long, p string, k string, m int, s long, h string, t string")
    return entries(df, image_id=F.col("i"), layer_idx=F.col("l"), entry_idx=F.col("e"), path=F.col("p"), kind=F.col("k"), mode=F.coalesce("m", F.lit(0o644)), size=F.coalesce("s", F.lit(0)), content_hash=F.col("h"), link_target=F.col("t"))


def live_paths(spark, rows):
    return {r["path"] for r in squash.live(squash.squash(table(spark, rows))).collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["squash_with_tombstones", "shadow_rows", "path_order", "link_closure", "naive_membership", "effective_membership", "dissolve_small_layers", "layer_stack", "dedup_summary", "set_algebra", "t0_format", "scalar_sizes"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) == set(catalog.queries()) and set(catalog.queries()) <= set(__spark_entry__.queries())


def test_same_layer_marker_and_recreation(spark):
    rows = [(0, 0, 0, "a", "Directory"), (0, 0, 1, "a/x", "Regular"), (0, 0, 2, "a/.wh.x", "Regular"), (0, 0, 3, "a/y", "Regular"), (0, 1, 0, "a/.wh..wh..opq", "Regular"), (0, 1, 1, "a/z", "Regular"), (0, 1, 2, "a/x", "Regular")]
    assert live_paths(spark, rows) == {"a", "a/z", "a/x"}


def test_bare_marker_is_a_file_and_look_alikes_stay(spark):
    rows = [(0, 0, 0, "etc/.wh.", "Regular"), (0, 0, 1, "etc/host", "Directory"), (0, 0, 2, "etc/host/x", "Regular"), (0, 0, 3, "etc/hostname", "Regular"), (0, 1, 0, "etc/.wh.host", "Regular")]
    assert live_paths(spark, rows) == {"etc/.wh.", "etc/hostname"}


def test_root_opaque_clears_all_before(spark):
    assert live_paths(spark, [(0, 0, 0, "a", "Regular"), (0, 1, 0, ".wh..wh..opq", "Regular"), (0, 1, 1, "b", "Regular"), (1, 0, 0, "a", "Regular")]) == {"a", "b"}


def test_file_over_directory_keeps_children(spark):
    rows = squash.live(squash.squash(table(spark, [(0, 0, 0, "d", "Directory"), (0, 0, 1, "d/x", "Regular"), (0, 1, 0, "d", "Regular")])))
    assert {r["path"] for r in rows.collect()} == {"d", "d/x"}
    assert [r["path"] for r in squash.children_of_files(rows).collect()] == ["d/x"]


def test_link_kept_demoted_and_faulty(spark):
    rows = [(0, 0, 0, "a", "Regular", 0o600, 5, "h"), (0, 0, 1, "b", "Hardlink", None, None, None, "./a"), (0, 0, 2, "c", "Hardlink", None, None, None, "b"), (0, 0, 3, "keep", "Hardlink", None, None, None, "c"), (0, 1, 0, ".wh.a", "Regular"), (0, 1, 1, ".wh.b", "Regular")]
    out = {r["path"]: r for r in links.resolve(squash.squash(table(spark, rows))).collect()}
    assert (out["c"]["kind"], out["c"]["mode"], out["c"]["size"], out["c"]["content_hash"], out["c"]["entry_idx"]) == ("Regular", 0o600, 5, "h", 0)
    assert out["keep"]["kind"] == "Hardlink"
    for bad in ([(0, 0, 0, "x", "Hardlink", None, None, None, "gone")], [(0, 0, 0, "d", "Directory"), (0, 0, 1, "l", "Hardlink", None, None, None, "d"), (0, 0, 2, "m", "Hardlink", None, None, None, "l"), (0, 1, 0, ".wh.l", "Regular")], [(0, 0, 0, "p", "Hardlink", None, None, None, "q"), (0, 0, 1, "q", "Hardlink", None, None, None, "p"), (0, 0, 2, "r", "Hardlink", None, None, None, "q"), (0, 1, 0, ".wh.q", "Regular")]):
        with pytest.raises(MalformedInputError):
            links.resolve(squash.squash(table(spark, bad)))


def test_ancestor_mode_splits_classes(spark):
    rows = [(i, 0, 0, "d", "Directory", 0o700 if i == 2 else 0o755) for i in range(3)] + [(i, 0, 1, "d/f", "Regular", 0o644, 9, "h") for i in range(4)]
    signed = membership.with_signature(identity.with_identity(squash.live(squash.squash(table(spark, rows)))))
    got = sorted(tuple(r["m"]) for r in membership.effective(signed.filter("path = 'd/f'")).collect())
    assert got == [(0, 1), (2,), (3,)]  # image 3 lacks the directory
    layers = partition.subset_layers(signed)
    assert partition.missing_ancestors(partition.backfill(layers, squash.live(squash.squash(table(spark, rows)))).filter("m[0] <> 3")).count() == 0


def _model(images, threshold):
    """Layers one at a time, over plain dictionaries. images: path -> (kind, mode, size)."""
    up = lambda p: [p.rsplit("/", k)[0] for k in range(1, p.count("/") + 1)]
    groups = defaultdict(set)
    for i, fs in enumerate(images):
        for p, v in fs.items():
            groups[p, v, tuple(fs.get(a) for a in up(p))].add(i)
    out = defaultdict(dict)

    def put(m, p, i, v):
        if p not in out[m] or i < out[m][p][0]:
            out[m][p] = (i, v)

    def fill(m):
        for p in list(out[m]):
            for a in up(p):
                if a not in out[m] and a in images[m[0]]:
                    out[m][a] = (m[0], images[m[0]][a])

    for (p, v, _), ids in groups.items():
        put(tuple(sorted(ids)), p, min(ids), v)
    for m in list(out):
        fill(m)
    size = lambda m: 1024 + sum(512 + (-(-v[2] // 512) * 512 if v[0] == "Regular" else 0) for _, v in out[m].values())
    for m in sorted((m for m in out if len(m) > 1), key=lambda m: (-len(m), m)):
        if size(m) < threshold:
            for p, (i, v) in out.pop(m).items():
                for j in m:
                    fits = [c for c in out if j in c and set(c) < set(m)]
                    dest = min(fits, key=lambda c: (-len(c), c)) if fits else (j,)
                    put(dest, p, i, v)
            for c in list(out):
                fill(c)
    return {(m, p): (i, *v) for m, rows in out.items() for p, (i, v) in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_layers_equal_a_sequential_model(spark, seed):
    r = random.Random(seed)
    images = []
    for _ in range(4):
        fs = {}
        for d in "abc":
            if r.random() < 0.9:
                fs[d] = ("Directory", r.choice((0, 0, 1)), 0)
                for e in "xy":
                    if r.random() < 0.7:
                        fs[f"{d}/{e}"] = ("Directory", 0, 0)
                        for f in "12":
                            if r.random() < 0.7:
                                fs[f"{d}/{e}/{f}"] = ("Regular", r.choice((0, 0, 0, 1)), r.choice((0, 700)))
        images.append(fs)
    live = squash.live(squash.squash(table(spark, [(i, 0, k, p, v[0], v[1], v[2]) for i, fs in enumerate(images) for k, (p, v) in enumerate(fs.items())])))
    layers = partition.backfill(partition.subset_layers(membership.with_signature(identity.with_identity(live))), live)
    out = compact.dissolve(layers, live, 4096)
    got = {(tuple(x["m"]), x["path"]): (x["image_id"], x["kind"], x["mode"], x["size"]) for x in out.collect()}
    assert got == _model(images, 4096)
    assert verify.differences(live, verify.reapplied(out, stack.stacks(out.select("m")))).count() == 0


def test_colocation_flattens_chains(spark):
    rows = [(0, 0, 0, "d", "Directory"), (0, 0, 1, "d/a", "Regular", 0o644, 9, "h"), (0, 0, 2, "b", "Hardlink", None, None, None, "d/a"), (0, 0, 3, "c", "Hardlink", None, None, None, "b"), (1, 0, 0, "d", "Directory"), (1, 0, 1, "d/a", "Regular", 0o644, 9, "h")]
    live = links.resolve(squash.squash(table(spark, rows)))
    layers = partition.subset_layers(membership.with_signature(identity.with_identity(live)))
    out = {(tuple(x["m"]), x["path"]): x for x in links.colocate(layers, live).collect()}
    assert out[(0,), "c"]["link_target"] == out[(0,), "b"]["link_target"] == "d/a" and ((0,), "d/a") in out and ((0, 1), "d/a") in out
    assert [r["members"] for r in verify.link_groups(live).collect()] == [["b", "c"]]


def test_path_functions(spark):
    raw = ["./a/b/", "//a", "/a", "./", "a//", ".", "a/b/c"]
    got = [r["x"] for r in spark.createDataFrame([(k, p) for k, p in enumerate(raw)], "k int, p string").orderBy("k").select(paths.normalise(F.col("p")).alias("x")).collect()]
    assert got == ["a/b", "/a", "a", "", "a", ".", "a/b/c"]
    assert one(spark, paths.strict_ancestors(F.lit("a/b/c"))) == ["a/b", "a"] and one(spark, paths.strict_ancestors(F.lit("a"))) == []
    order = spark.createDataFrame([("a-b",), ("a/b",), ("a",)], "p string").orderBy(paths.components(F.col("p")))
    assert [r["p"] for r in order.collect()] == ["a", "a/b", "a-b"]
    assert one(spark, paths.is_strict_descendant(F.lit("etc/hostname"), F.lit("etc/host"))) is False


def test_scalars(spark):
    assert one(spark, scalars.permille(F.lit(1), F.lit(2000))) == 1 and one(spark, scalars.permille(F.lit(0), F.lit(0))) == 0
    assert one(spark, scalars.rfc3339(F.lit(1_700_000_000))) == "2023-11-14T22:13:20Z"
    assert one(spark, scalars.rfc3339(F.lit(10**15))) == "9999-12-31T23:59:59Z"
    assert scalars.parse_size("16k") == 16384 and scalars.parse_size("2Gi") == 2 << 30
    for n in (1, 5, 96, 97, 98, 995, 996, 997, 998):
        assert one(spark, scalars.record_length(F.lit(n))) == len(b"%d" % one(spark, scalars.record_length(F.lit(n)))) + n + 2


def test_reports(spark):
    sizes = spark.createDataFrame([([0, 1], 1000), ([0], 10)], "m array<int>, bytes long")
    t = report.totals(sizes).first()
    assert (int(t["inputs_total"]), int(t["outputs_total"]), int(t["saved"]), t["saved_permille"]) == (2010, 1010, 1000, 498)
    assert {r["vs_naive"] for r in report.layer_labels(sizes).collect()} == {"+1000", "—"}
    images = spark.createDataFrame([(0, "x", "l", None), (1, "x", "l", "v8")], "i int, architecture string, os string, variant string")
    assert [r["field"] for r in report.platform_divergence(images).collect()] == ["variant"]


def test_stream_equals_batch(spark, tmp_path):
    rows = catalog.adapters.change_log(spark, SF)
    for k in range(3):
        rows.filter(F.col("entry_idx") % 3 == 2 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, state = squash_stream(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    query.awaitTermination()
    keep = ["image_id", "path", "layer_idx", "entry_idx", "kind", "alive"]
    assert sorted(state.state().select(*keep).collect()) == sorted(squash.squash(rows).select(*keep).collect())
