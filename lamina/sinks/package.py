"""Packing an artifact as a directory or an archive; publishing it by a rename."""

from __future__ import annotations

import os
import shutil

from lamina.errors import OutputExistsError, ValidationError
from lamina.sinks.documents import LAYOUT_FILE, canonical_json
from lamina.sinks.tar_encode import TRAILER, entry_head, padding

_CHUNK = 1 << 20


def partial_path(output: str) -> str:
    return output.rstrip("/") + ".partial"


def scratch_path(output: str, layout: str, scratch: str | None = None) -> str:
    return scratch or output.rstrip("/") + (".staging" if layout == "tar" else ".partial")


def prepare_destination(output: str, force: bool, t0: int) -> str | None:
    """Refuses an output that exists, or with `force` moves it aside and returns where; nothing is
    ever overwritten. A half-written output of an earlier run counts too."""
    moved = None
    for path in (output, partial_path(output)):
        if not os.path.lexists(path):
            continue
        if not force:
            raise OutputExistsError(f"{path} exists")
        aside = f"{path.rstrip('/')}.old-{t0}"
        if os.path.lexists(aside):
            raise OutputExistsError(f"{aside} exists")
        os.rename(path, aside)
        moved = aside if path == output else moved
    return moved


def validate(staging: str, images: list[dict]) -> None:
    """Every blob that a document names is there with its size, and digests, layers and stacks
    agree. images: manifest, config, config_digest and stack of each."""
    folder = os.path.join(staging, "blobs", "sha256")
    for k, x in enumerate(images):
        for d in (x["manifest"]["config"], *x["manifest"]["layers"]):
            file = os.path.join(folder, d["digest"].partition(":")[2])
            if not os.path.isfile(file) or os.path.getsize(file) != d["size"]:
                raise ValidationError(f"image {k}: blob {d['digest']} is missing or has another size")
        listed = [d["digest"] for d in x["manifest"]["layers"]]
        stacked = [f"sha256:{s['digest']}" for s in x["stack"]]
        if not listed == stacked == x["config"]["rootfs"]["diff_ids"]:
            raise ValidationError(f"image {k}: layers, digests and stack don't agree")


def _referenced(images: list[dict]) -> list[str]:
    out = set()
    for x in images:
        out |= {x["manifest_digest"], x["config_digest"], *(s["digest"] for s in x["stack"])}
    return sorted(out)


def as_directory(staging: str, images: list[dict], index: dict, docker: list[dict], output: str) -> None:
    """Only blobs that documents name are kept."""
    folder = os.path.join(staging, "blobs", "sha256")
    wanted = set(_referenced(images))
    partial = partial_path(output)
    target = os.path.join(partial, "blobs", "sha256")
    os.makedirs(target, exist_ok=True)
    for name in sorted(wanted):
        if os.path.abspath(folder) != os.path.abspath(target):
            shutil.move(os.path.join(folder, name), os.path.join(target, name))
    for name, data in (("oci-layout", LAYOUT_FILE), ("index.json", canonical_json(index)), ("manifest.json", canonical_json(docker))):
        with open(os.path.join(partial, name), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
    os.rename(partial, output)


def as_archive(staging: str, images: list[dict], index: dict, docker: list[dict], output: str, t0: int) -> None:
    """Entries in the order of their names; blobs are copied as streams."""
    folder, partial = os.path.join(staging, "blobs", "sha256"), partial_path(output)
    with open(partial, "wb") as out:

        def put(name: str, kind: str, mode: int, size: int = 0) -> None:
            out.write(entry_head(name.encode(), kind, mode=mode, uid=0, gid=0, size=size, mtime=t0))

        put("blobs", "Directory", 0o755)
        put("blobs/sha256", "Directory", 0o755)
        for name in _referenced(images):
            file = os.path.join(folder, name)
            size = os.path.getsize(file)
            put(f"blobs/sha256/{name}", "Regular", 0o644, size)
            with open(file, "rb") as f:
                shutil.copyfileobj(f, out, _CHUNK)
            out.write(padding(size))
        for name, data in (("index.json", canonical_json(index)), ("manifest.json", canonical_json(docker)), ("oci-layout", LAYOUT_FILE)):
            put(name, "Regular", 0o644, len(data))
            out.write(data + padding(len(data)))
        out.write(TRAILER)
        out.flush()
        os.fsync(out.fileno())
    os.rename(partial, output)
