import io
import json
import tarfile

import pytest

from lamina import cli
from lamina.errors import DigestMismatchError, MalformedInputError, OutputExistsError, UsageError, ValidationError
from lamina.operators import squash, verify
from lamina.plans.run import Config, capture_t0, run
from lamina.sinks import package, tar_encode
from lamina.sources import layer_scan, layouts
from tests import archives as ar

BASE = ar.layer(ar.ALL_KINDS)
SECOND = ar.layer([("shop/.wh.prices-today", "Regular", {}), ("shop/ledger", "Regular", {"body": b"x" * 70_000}), ("yard", "Directory", {"mode": 0o700}), ("yard/" + "long" * 40, "Regular", {"body": b"deep"})])
OTHER = ar.layer([("shop/ledger", "Regular", {"body": b"x" * 70_000}), ("shop/till", "Directory", {}), ("shop/till/.wh..wh..opq", "Regular", {}), ("shop/till/new", "Regular", {"body": b"new"})])


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    return [str(ar.dir_transport(d / "a", [BASE, SECOND], pack=True)), str(ar.docker_tar(d / "b.tar", [(["b:1"], [BASE, OTHER]), (["c:1", "c:2"], [BASE])]))]


def _layers_of(path) -> list[list[bytes]]:
    """Each output image's layers, parsed independently."""
    with tarfile.open(path) as t:
        files = {m.name: t.extractfile(m).read() for m in t if m.isreg()}
    out = []
    for x in json.loads(files["manifest.json"]):
        out.append([files[n] for n in x["Layers"]])
    return out


def test_round_trip_and_determinism(spark, inputs, tmp_path):
    first, again = str(tmp_path / "one.tar"), str(tmp_path / "two.tar")
    s = run(spark, Config(first, inputs, timestamp=1_700_000_000, min_layer_size=0))
    run(spark, Config(again, inputs[::-1], timestamp=1_700_000_000, min_layer_size=0))
    assert open(first, "rb").read() == open(again, "rb").read()
    got = [ar.final_tree(x) for x in _layers_of(first)]
    assert got == [ar.final_tree(x) for x in ([BASE, SECOND], [BASE, OTHER], [BASE])]
    assert s.totals["saved"] > 0 and any(label.startswith("shared {0,1,2}") for label, *_ in s.layers)
    assert "2023-11-14T22:13:20Z" in str(s) and f"saved {s.totals['saved']} bytes" in str(s)
    with tarfile.open(first) as t:
        assert t.getnames()[:2] == ["blobs", "blobs/sha256"] and t.getnames()[-3:] == ["index.json", "manifest.json", "oci-layout"]
        index = json.load(t.extractfile("index.json"))
    assert len(index["manifests"]) == 4  # one untagged, one with a tag, one with two
    assert not (tmp_path / "one.tar.staging").exists()


def test_directory_output_read_back(spark, inputs, tmp_path):
    out = str(tmp_path / "dir")
    run(spark, Config(out, inputs, layout="dir", timestamp=1))
    images, warnings = layouts.load([out])
    assert len(images) == 4 and warnings
    assert sorted(p.name for p in (tmp_path / "dir").iterdir()) == ["blobs", "index.json", "manifest.json", "oci-layout"]
    again = str(tmp_path / "again.tar")
    run(spark, Config(again, [out], timestamp=1))
    assert ar.final_tree(_layers_of(again)[0]) == ar.final_tree([BASE, SECOND])
    with pytest.raises(OutputExistsError):
        run(spark, Config(out, inputs, layout="dir", timestamp=1))
    run(spark, Config(out, inputs, layout="dir", timestamp=1, force=True))
    assert (tmp_path / "dir.old-1").is_dir()


def test_dry_run_writes_nothing(spark, inputs, tmp_path):
    s = run(spark, Config(str(tmp_path / "x.tar"), inputs, dry_run=True, timestamp=0))
    assert list(tmp_path.iterdir()) == [] and all(d == "(dry run)" for *_, d in s.layers)


def test_scan_has_all_kinds(spark, inputs):
    images, _ = layouts.load(inputs[:1])
    rows = layer_scan.read_layers(spark, layer_scan.layer_rows(images)[:1]).collect()
    by = {r["path"]: r for r in rows}
    assert len(rows) == len(ar.ALL_KINDS) and {(r["path"], r["kind"]) for r in rows} == {(p, k) for p, k, _ in ar.ALL_KINDS}
    assert by["shop/till/open"]["mode"] == 0o6711 and by["shop"]["mode"] == 0o1775
    assert (by["shop/safe"]["rdev_major"], by["shop/safe"]["rdev_minor"]) == (259, 70)
    assert [bytes(x["k"]) for x in by["shop/prices"]["xattrs"]] == [b"trusted.rank", b"user.origin"]
    live = squash.live(squash.squash(layer_scan.read_layers(spark, layer_scan.layer_rows(images)).drop("body_offset")))
    assert {r["path"] for r in live.collect()} == set(ar.final_tree([BASE, SECOND]))


def test_damaged_layer(spark, tmp_path):
    d = ar.dir_transport(tmp_path / "a", [BASE])
    name = json.loads((d / "manifest.json").read_text())["layers"][0]["digest"][7:]
    data = bytearray((d / name).read_bytes())
    data[600] ^= 1
    (d / name).write_bytes(data)
    with pytest.raises(DigestMismatchError):
        run(spark, Config(str(tmp_path / "o.tar"), [str(d)], timestamp=0))


def test_layout_detection(tmp_path, inputs):
    assert layouts.detect(inputs[0])[0] == layouts.DIR_TRANSPORT
    assert layouts.detect(inputs[1])[0] == layouts.DOCKER_TAR
    (tmp_path / "oci-layout").write_text("{}")
    (tmp_path / "manifest.json").write_text("[]")
    layout, warning = layouts.detect(str(tmp_path))
    assert layout == layouts.OCI_DIR and warning
    (tmp_path / "oci-layout").unlink()
    assert layouts.detect(str(tmp_path))[0] == layouts.DOCKER_DIR
    (tmp_path / "manifest.json").unlink()
    with pytest.raises(MalformedInputError):
        layouts.detect(str(tmp_path))


def test_compression_must_match(tmp_path):
    d = ar.dir_transport(tmp_path / "a", [BASE])
    m = json.loads((d / "manifest.json").read_text())
    m["layers"][0]["mediaType"] += "+gzip"
    (d / "manifest.json").write_text(json.dumps(m))
    with pytest.raises(MalformedInputError):
        layouts.load([str(d)])


def test_time_sources():
    assert capture_t0(5, {"SOURCE_DATE_EPOCH": "7"}) == (5, "option")
    assert capture_t0(None, {"SOURCE_DATE_EPOCH": " 7 "}) == (7, "environment")
    with pytest.raises(UsageError):
        capture_t0(None, {"SOURCE_DATE_EPOCH": "x"})


def test_exit_codes(inputs, tmp_path, monkeypatch):
    assert cli.main([]) == 2
    assert cli.main(["-o", "x", "-v", "-q", "y"]) == 2
    assert cli.main(["-o", "x", "--min-layer-size", "4q", "y"]) == 2
    assert cli.log_level(0, True, {}) == 40 and cli.log_level(1, False, {}) == 20 and cli.log_level(0, True, {"LAMINA_LOG": "debug"}) == 10


def _trees(out):
    return [ar.final_tree(x) for x in _layers_of(out)]


@pytest.mark.parametrize("pack", [False, "gzip", "zstd"])
def test_every_layout_gives_the_same_images(spark, tmp_path, pack):
    want = [ar.final_tree(x) for x in ([BASE, SECOND], [BASE, OTHER])]
    tar = ar.oci_tar(tmp_path / "i.tar", [("x:1", [BASE, SECOND]), (None, [BASE, OTHER])], pack)
    assert layouts.detect(str(tar))[0] == layouts.OCI_TAR
    run(spark, Config(str(tmp_path / "o.tar"), [str(tar)], timestamp=0, min_layer_size=0))
    assert _trees(tmp_path / "o.tar") == want
    if not pack:
        folder = ar.docker_dir(tmp_path / "docker", [(["x:1"], [BASE, SECOND]), ([], [BASE, OTHER])])
        assert layouts.detect(str(folder))[0] == layouts.DOCKER_DIR
        run(spark, Config(str(tmp_path / "d.tar"), [str(folder)], timestamp=0, min_layer_size=0))
        assert _trees(tmp_path / "d.tar") == want


def test_link_groups_survive(spark, tmp_path):
    d = ar.dir_transport(tmp_path / "a", [BASE, SECOND])
    images, _ = layouts.load([str(d)])
    live = squash.live(squash.squash(layer_scan.read_layers(spark, layer_scan.layer_rows(images)).drop("body_offset")))
    out = str(tmp_path / "out")
    run(spark, Config(out, [str(d)], layout="dir", timestamp=0, min_layer_size=0))
    again, _ = layouts.load([out])
    back = squash.live(squash.squash(layer_scan.read_layers(spark, layer_scan.layer_rows(again)).drop("body_offset")))
    groups = lambda rows: {frozenset([r["terminal"], *r["members"]]) for r in verify.link_groups(rows).collect()}
    assert groups(live) == groups(back) == {frozenset(["shop/till/open", "shop/till/open-too"])}


def test_faults_within_an_archive(tmp_path):
    whole = ar.oci_tar(tmp_path / "i.tar", [("x:1", [BASE])])
    with tarfile.open(whole) as t:
        files = [(m, t.extractfile(m).read()) for m in t]
    layer = max((m.name for m, _ in files), key=lambda n: next(len(d) for m, d in files if m.name == n))
    with tarfile.open(tmp_path / "lacks.tar", "w") as t:
        for m, data in files:
            if m.name != layer:
                t.addfile(m, io.BytesIO(data))
    with pytest.raises(MalformedInputError, match="lacks"):
        layouts.load([str(tmp_path / "lacks.tar")])
    d = ar.dir_transport(tmp_path / "ids", [BASE, SECOND])
    m = json.loads((d / "manifest.json").read_text())
    m["layers"].pop()
    (d / "manifest.json").write_text(json.dumps(m))
    with pytest.raises(MalformedInputError, match="2 diff ids for 1 layers"):
        layouts.load([str(d)])


def test_codes_of_the_command(inputs, spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    out = tmp_path / "o.tar"
    assert cli.main(["-o", str(out), "--timestamp", "0", *inputs]) == 0
    assert cli.main(["-o", str(out), "--timestamp", "0", *inputs]) == 3
    (tmp_path / "none").mkdir()
    assert cli.main(["-o", str(tmp_path / "p.tar"), str(tmp_path / "none")]) == 1
    d = ar.dir_transport(tmp_path / "bad", [BASE])
    name = json.loads((d / "manifest.json").read_text())["layers"][0]["digest"][7:]
    (d / name).write_bytes((d / name).read_bytes()[:-1] + b"x")
    assert cli.main(["-o", str(tmp_path / "q.tar"), str(d)]) == 4
    assert "lamina:" in capsys.readouterr().err


def test_validation_fails_when_it_should(tmp_path):
    blobs = tmp_path / "blobs" / "sha256"
    blobs.mkdir(parents=True)
    for name in ("aa", "bb"):
        (blobs / name).write_bytes(b"12345")
    described = lambda name, size=5: {"digest": f"sha256:{name}", "size": size}
    image = lambda **more: {"manifest": {"config": described("aa"), "layers": [described("bb")]}, "config": {"rootfs": {"diff_ids": ["sha256:bb"]}}, "config_digest": "aa", "stack": [{"digest": "bb"}]} | more
    package.validate(str(tmp_path), [image()])
    for bad in (
        image(manifest={"config": described("aa"), "layers": [described("cc")]}),
        image(manifest={"config": described("aa", 4), "layers": [described("bb")]}),
        image(config={"rootfs": {"diff_ids": ["sha256:aa"]}}),
        image(stack=[]),
    ):
        with pytest.raises(ValidationError):
            package.validate(str(tmp_path), [bad])


def test_manifest_faults(spark):
    layers = spark.createDataFrame([([0, 1], "a"), ([0], "b"), ([1], None)], "m array<int>, digest string")
    stacks = spark.createDataFrame([(0, 0, [0, 1]), (0, 1, [0]), (1, 0, [0, 1]), (1, 1, [1]), (2, 0, [0])], "image_id int, position int, m array<int>")
    listed = spark.createDataFrame([(0, 0, "a"), (0, 1, "x"), (0, 2, "z"), (1, 0, "a"), (1, 1, "c")], "image_id int, position int, diff_id string")
    got = {(r["image_id"], r["position"]): r["fault"] for r in verify.manifest_faults(layers, stacks, listed).collect()}
    assert got == {(0, 1): "another digest", (0, 2): "a digest without a layer", (1, 1): "a layer that was not written", (2, 0): "a layer without a digest"}


def test_numbers_and_names_that_overflow_their_fields():
    big = dict(mode=0o640, uid=3_000_000, gid=2_097_152, size=0, mtime=9)
    long_path, long_link = "säge/" * 70 + "blatt", "ziel/" * 40
    head = tar_encode.entry_head(long_path.encode(), "Symlink", link=long_link.encode(), **big)
    with tarfile.open(fileobj=io.BytesIO(head + bytes(1024))) as t:
        m = t.next()
    assert (m.name, m.linkname, m.uid, m.gid, m.mode) == (long_path, long_link, 3_000_000, 2_097_152, 0o640)
    head = tar_encode.entry_head(b"f", "Regular", **(big | {"size": 9 << 33}))
    with tarfile.open(fileobj=io.BytesIO(head)) as t:
        assert t.next().size == 9 << 33
    assert tar_encode._cut(("é" * 60).encode()) == ("é" * 50).encode() and len(tar_encode._cut(("a" + "é" * 60).encode())) == 99
    with pytest.raises(ValidationError):
        tar_encode.entry_head(b"s", "Socket", **big)
