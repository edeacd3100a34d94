"""Container archives on disk: what they are, and the images and layers in them.

Only headers and JSON documents are read here, on the driver; layers stay pointers (file, offset,
length), so any task can open them.
"""

from __future__ import annotations

import json
import os
import tarfile
from dataclasses import dataclass, field

from lamina.errors import MalformedInputError

OCI_DIR, OCI_TAR, DOCKER_DIR, DOCKER_TAR, DIR_TRANSPORT = "oci-dir", "oci-tar", "docker-dir", "docker-tar", "dir"
MARKERS = ("oci-layout", "manifest.json")

#: Media types of layers and how they are compressed.
COMPRESSIONS = {
    "application/vnd.oci.image.layer.v1.tar": "none",
    "application/vnd.oci.image.layer.v1.tar+gzip": "gzip",
    "application/vnd.oci.image.layer.v1.tar+zstd": "zstd",
    "application/vnd.oci.image.layer.nondistributable.v1.tar": "none",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+gzip": "gzip",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+zstd": "zstd",
    "application/vnd.docker.image.rootfs.diff.tar": "none",
    "application/vnd.docker.image.rootfs.diff.tar.gzip": "gzip",
    "application/vnd.docker.image.rootfs.diff.tar.zstd": "zstd",
}


@dataclass
class Blob:
    """Bytes within a file."""

    file: str
    offset: int
    length: int

    def read(self) -> bytes:
        with open(self.file, "rb") as f:
            f.seek(self.offset)
            return f.read(self.length)


@dataclass
class Layer:
    blob: Blob
    digest: str
    diff_id: str
    size: int
    media_type: str
    compression: str


@dataclass
class Image:
    """One image; layers from the bottom up."""

    config: dict
    layers: list[Layer]
    repo_tags: list[str] = field(default_factory=list)


def canonical_inputs(inputs: list[str]) -> list[str]:
    """Real paths, sorted, each once, so that image ids depend on the set of inputs only."""
    for p in inputs:
        if not os.path.exists(p):
            raise MalformedInputError(f"no such input: {p}")
    return sorted({os.path.realpath(p) for p in inputs}, key=os.fsencode)


def _tar_blobs(path: str) -> dict[str, Blob]:
    """Where each file of an archive lies."""
    try:
        with tarfile.open(path, "r:") as t:
            return {os.path.normpath(m.name).lstrip("/"): Blob(path, m.offset_data, m.size) for m in t if m.isreg()}
    except tarfile.TarError as e:
        raise MalformedInputError(f"{path} is no archive: {e}") from e


def _tar_markers(path: str) -> set[str]:
    """The markers in an archive; stops when it has both."""
    found: set[str] = set()
    try:
        with tarfile.open(path, "r:") as t:
            for m in t:
                found |= {os.path.normpath(m.name).lstrip("/")} & set(MARKERS)
                if len(found) == len(MARKERS):
                    break
    except tarfile.TarError as e:
        raise MalformedInputError(f"{path} is no archive: {e}") from e
    return found


def detect(path: str) -> tuple[str, str | None]:
    """The layout of an input, by what is in it, and a warning if it could be two."""
    if os.path.isdir(path):
        found = {m for m in MARKERS if os.path.isfile(os.path.join(path, m))}
        oci, docker = OCI_DIR, DOCKER_DIR
    else:
        found, oci, docker = _tar_markers(path), OCI_TAR, DOCKER_TAR
    if "oci-layout" in found:
        return oci, f"{path} is both layouts; it is read by oci-layout" if len(found) == 2 else None
    if "manifest.json" in found:
        if docker == DOCKER_DIR:
            with open(os.path.join(path, "manifest.json"), "rb") as f:
                head = f.read().lstrip()[:1]
            if head == b"{":
                return DIR_TRANSPORT, None
            if head != b"[":
                raise MalformedInputError(f"{path}/manifest.json is neither a list nor an object")
        return docker, None
    raise MalformedInputError(f"{path} has neither of {' and '.join(MARKERS)}")


def _json(blob: Blob, what: str):
    try:
        return json.loads(blob.read())
    except ValueError as e:
        raise MalformedInputError(f"{what} is no JSON: {e}") from e


def _compression(media_type: str, blob: Blob) -> str:
    """By media type; the first bytes must not contradict."""
    if media_type not in COMPRESSIONS:
        raise MalformedInputError(f"unknown media type {media_type}")
    declared = COMPRESSIONS[media_type]
    head = Blob(blob.file, blob.offset, min(4, blob.length)).read()
    seen = "gzip" if head[:2] == b"\x1f\x8b" else "zstd" if head == b"\x28\xb5\x2f\xfd" else "none"
    if seen != declared:
        raise MalformedInputError(f"a layer of type {media_type} is {seen}")
    return declared


def _image(config: dict, descriptors: list[dict], find, tags: list[str]) -> Image:
    diff_ids = config.get("rootfs", {}).get("diff_ids", [])
    if len(diff_ids) != len(descriptors):
        raise MalformedInputError(f"{len(diff_ids)} diff ids for {len(descriptors)} layers")
    layers = []
    for d, diff_id in zip(descriptors, diff_ids, strict=True):
        blob = find(d["digest"])
        layers.append(Layer(blob, d["digest"], diff_id, int(d["size"]), d["mediaType"], _compression(d["mediaType"], blob)))
    return Image(config, layers, tags)


def _oci(path: str, is_dir: bool) -> list[Image]:
    blobs = None if is_dir else _tar_blobs(path)

    def at(name: str) -> Blob:
        if is_dir:
            file = os.path.join(path, name)
            if not os.path.isfile(file):
                raise MalformedInputError(f"{path} lacks {name}")
            return Blob(file, 0, os.path.getsize(file))
        if name not in blobs:
            raise MalformedInputError(f"{path} lacks {name}")
        return blobs[name]

    find = lambda digest: at("blobs/" + digest.replace(":", "/", 1))
    out = []
    for d in _json(at("index.json"), "index.json").get("manifests", []):
        manifest = _json(find(d["digest"]), d["digest"])
        if "layers" not in manifest:
            raise MalformedInputError(f"{d['digest']} is no image manifest")
        notes = d.get("annotations") or {}
        tag = notes.get("io.containerd.image.name") or notes.get("org.opencontainers.image.ref.name")
        out.append(_image(_json(find(manifest["config"]["digest"]), "config"), manifest["layers"], find, [tag] if tag else []))
    return out


def _docker(path: str, is_dir: bool) -> list[Image]:
    blobs = None if is_dir else _tar_blobs(path)

    def at(name: str) -> Blob:
        file = os.path.join(path, name)
        if is_dir and os.path.isfile(file):
            return Blob(file, 0, os.path.getsize(file))
        if is_dir or os.path.normpath(name) not in blobs:
            raise MalformedInputError(f"{path} lacks {name}")
        return blobs[os.path.normpath(name)]

    out = []
    for entry in _json(at("manifest.json"), "manifest.json"):
        config = _json(at(entry["Config"]), entry["Config"])
        diff_ids = config.get("rootfs", {}).get("diff_ids", [])
        names = entry.get("Layers") or []
        if len(diff_ids) != len(names):
            raise MalformedInputError(f"{len(diff_ids)} diff ids for {len(names)} layers")
        layers = [Layer(b := at(name), diff_id, diff_id, b.length, "application/vnd.oci.image.layer.v1.tar", "none") for name, diff_id in zip(names, diff_ids, strict=True)]
        out.append(Image(config, layers, list(entry.get("RepoTags") or [])))
    return out


def _dir_transport(path: str) -> list[Image]:
    def find(digest: str) -> Blob:
        file = os.path.join(path, digest.partition(":")[2])
        if not os.path.isfile(file):
            raise MalformedInputError(f"{path} lacks {digest}")
        return Blob(file, 0, os.path.getsize(file))

    manifest = _json(Blob(os.path.join(path, "manifest.json"), 0, -1), "manifest.json")
    return [_image(_json(find(manifest["config"]["digest"]), "config"), manifest["layers"], find, [])]


def load(inputs: list[str]) -> tuple[list[Image], list[str]]:
    """All images of all inputs in order, their place being their id; and warnings."""
    images, warnings = [], []
    for path in canonical_inputs(inputs):
        layout, warning = detect(path)
        warnings += [warning] * bool(warning)
        if layout in (OCI_DIR, OCI_TAR):
            images += _oci(path, layout == OCI_DIR)
        elif layout in (DOCKER_DIR, DOCKER_TAR):
            images += _docker(path, layout == DOCKER_DIR)
        else:
            images += _dir_transport(path)
    return images, warnings
