"""Builds archives with the standard library, so that our own encoder isn't its own judge."""

import gzip
import hashlib
import io
import json
import tarfile
from pathlib import Path


def layer(entries) -> bytes:
    """A layer from (path, kind, more) with body, target, mode, uid, gid, rdev and xattrs in more."""
    out = io.BytesIO()
    types = {"Regular": tarfile.REGTYPE, "Directory": tarfile.DIRTYPE, "Symlink": tarfile.SYMTYPE, "Hardlink": tarfile.LNKTYPE, "CharDevice": tarfile.CHRTYPE, "BlockDevice": tarfile.BLKTYPE, "Fifo": tarfile.FIFOTYPE}
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for path, kind, more in entries:
            m = tarfile.TarInfo(path)
            m.type, m.mode = types[kind], more.get("mode", 0o755 if kind == "Directory" else 0o644)
            m.uid, m.gid = more.get("uid", 0), more.get("gid", 0)
            m.linkname = more.get("target", "")
            m.devmajor, m.devminor = more.get("rdev", (0, 0))
            m.pax_headers = {f"SCHILY.xattr.{k}": v for k, v in more.get("xattrs", {}).items()}
            body = more.get("body", b"")
            m.size = len(body)
            t.addfile(m, io.BytesIO(body) if kind == "Regular" else None)
    return out.getvalue()


#: One small image with an entry of every kind that a layer may hold, and unusual modes.
ALL_KINDS = [
    ("shop", "Directory", {"mode": 0o1775}),
    ("shop/till", "Directory", {}),
    ("shop/till/open", "Regular", {"mode": 0o6711, "uid": 7, "gid": 40, "body": bytes(range(256)) * 3}),
    ("shop/till/open-too", "Hardlink", {"mode": 0o6711, "target": "shop/till/open"}),
    ("shop/prices", "Regular", {"mode": 0o600, "body": "pêche 2 €\n".encode(), "xattrs": {"user.origin": "market", "trusted.rank": "3"}}),
    ("shop/prices-today", "Symlink", {"target": "../shop/prices"}),
    ("shop/bell", "Fifo", {"mode": 0o620}),
    ("shop/scanner", "CharDevice", {"mode": 0o640, "rdev": (188, 5)}),
    ("shop/safe", "BlockDevice", {"mode": 0o400, "rdev": (259, 70)}),
]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def config_of(layers, **more) -> bytes:
    return json.dumps({"architecture": "amd64", "os": "linux", "config": {"Env": ["A=1"]}, "rootfs": {"type": "layers", "diff_ids": [f"sha256:{_sha(x)}" for x in layers]}} | more).encode()


def _packed(layers, pack):
    """(bytes, media type) of each layer: plain, "gzip" or "zstd"."""
    kind = "application/vnd.oci.image.layer.v1.tar"
    if pack == "zstd":
        import zstandard

        return [zstandard.ZstdCompressor().compress(x) for x in layers], f"{kind}+zstd"
    return ([gzip.compress(x, mtime=0) for x in layers], f"{kind}+gzip") if pack else (layers, kind)


def dir_transport(folder: Path, layers, pack=False, **more) -> Path:
    folder.mkdir(parents=True)
    config = config_of(layers, **more)
    stored, kind = _packed(layers, pack)
    for data in (config, *stored):
        (folder / _sha(data)).write_bytes(data)
    manifest = {"schemaVersion": 2, "config": {"mediaType": "application/vnd.oci.image.config.v1+json", "digest": f"sha256:{_sha(config)}", "size": len(config)}, "layers": [{"mediaType": kind, "digest": f"sha256:{_sha(x)}", "size": len(x)} for x in stored]}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    return folder


def docker_tar(file: Path, images) -> Path:
    """images: (tags, layers)"""
    entries, listed = [], []
    for tags, layers in images:
        config = config_of(layers)
        entries += [(f"{_sha(config)}.json", config)] + [(f"{_sha(x)}/layer.tar", x) for x in layers]
        listed.append({"Config": f"{_sha(config)}.json", "RepoTags": tags, "Layers": [f"{_sha(x)}/layer.tar" for x in layers]})
    with tarfile.open(file, "w") as t:
        for name, data in {**dict(entries), "manifest.json": json.dumps(listed).encode()}.items():
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    return file


def docker_dir(folder: Path, images) -> Path:
    """The files of docker_tar, unpacked."""
    folder.mkdir(parents=True)
    with tarfile.open(docker_tar(folder.with_suffix(".whole.tar"), images)) as t:
        t.extractall(folder, filter="data")
    folder.with_suffix(".whole.tar").unlink()
    return folder


def oci_tar(file: Path, images, pack=False) -> Path:
    """images: (tag or None, layers), in the open layout, packed as a tar."""
    blobs, listed = {}, []

    def put(data: bytes, media: str) -> dict:
        blobs[f"blobs/sha256/{_sha(data)}"] = data
        return {"mediaType": media, "digest": f"sha256:{_sha(data)}", "size": len(data)}

    for tag, layers in images:
        stored, kind = _packed(layers, pack)
        manifest = {"schemaVersion": 2, "config": put(config_of(layers), "application/vnd.oci.image.config.v1+json"), "layers": [put(x, kind) for x in stored]}
        entry = put(json.dumps(manifest).encode(), "application/vnd.oci.image.manifest.v1+json")
        listed.append(entry | ({"annotations": {"org.opencontainers.image.ref.name": tag}} if tag else {}))
    files = {"oci-layout": b'{"imageLayoutVersion": "1.0.0"}', "index.json": json.dumps({"schemaVersion": 2, "manifests": listed}).encode(), **blobs}
    with tarfile.open(file, "w") as t:
        for name, data in files.items():
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    return file


def final_tree(layers) -> dict:
    """The files that layers make, by a fold over independently parsed records."""
    tree = {}
    for data in layers:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                path = m.name.strip("/")
                folder, _, base = path.rpartition("/")
                if base == ".wh..wh..opq":
                    for p in [p for p in tree if p.startswith(folder + "/") or not folder]:
                        del tree[p]
                elif base.startswith(".wh.") and base != ".wh.":
                    victim = f"{folder}/{base[4:]}".lstrip("/")
                    for p in [p for p in tree if p == victim or p.startswith(victim + "/")]:
                        del tree[p]
                else:
                    body = t.extractfile(m).read() if m.isreg() else b""
                    x = sorted((k, v) for k, v in m.pax_headers.items() if "xattr" in k)
                    tree[path] = [m.type, m.mode, m.uid, m.gid, m.linkname, (m.devmajor, m.devminor) if m.type in (b"3", b"4") else None, body, x]
    out = {}
    for path, v in tree.items():  # hardlinks count by what they lead to
        seen, where = set(), path
        while tree.get(where, [b""])[0] == tarfile.LNKTYPE and where not in seen:
            seen.add(where)
            where = tree[where][4]
        out[path] = ("link", where) if where != path else tuple(map(str, v))
    return out
