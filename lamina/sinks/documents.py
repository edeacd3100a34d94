"""The JSON documents of an artifact. They are small and built on the driver."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from lamina.functions.scalars import FIRST_SECOND, LAST_SECOND

#: Media types, annotations and the layout file.
CONFIG, MANIFEST, INDEX = "application/vnd.oci.image.config.v1+json", "application/vnd.oci.image.manifest.v1+json", "application/vnd.oci.image.index.v1+json"
LAYER = "application/vnd.oci.image.layer.v1.tar"
CREATED, REF_NAME = "org.opencontainers.image.created", "org.opencontainers.image.ref.name"
LAYOUT_FILE = b'{"imageLayoutVersion":"1.0.0"}'
#: What an output config keeps of its input.
KEPT = ("architecture", "os", "os.version", "os.features", "variant", "config")


def canonical_json(value) -> bytes:
    """Keys in order, no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def created(t0: int) -> str:
    held = max(min(t0, LAST_SECOND), FIRST_SECOND)
    at = datetime.fromtimestamp(held, UTC)
    return f"{at.year:04}-{at:%m-%dT%H:%M:%S}Z"


def created_by(m: tuple[int, ...]) -> str:
    return f"lamina, entries of image {m[0]} alone" if len(m) == 1 else f"lamina, entries that images {', '.join(map(str, m))} share"


def _descriptor(kind: str, digest: str, size: int, **more) -> dict:
    return {"mediaType": kind, "digest": f"sha256:{digest}", "size": size, **more}


def config(source: dict, stack: list[dict], t0: int) -> dict:
    """stack: the layers (m, digest, size) of an image from the bottom up."""
    out = {k: source[k] for k in KEPT if source.get(k) is not None}
    out["created"] = created(t0)
    out["rootfs"] = {"type": "layers", "diff_ids": [f"sha256:{x['digest']}" for x in stack]}
    out["history"] = [{"created": created(t0), "created_by": created_by(tuple(x["m"]))} for x in stack]
    return out


def manifest(config_digest: str, config_size: int, stack: list[dict], t0: int, tags: list[str]) -> dict:
    """A name is noted only if the image has exactly one."""
    notes = {CREATED: created(t0)} | ({REF_NAME: tags[0]} if len(tags) == 1 else {})
    return {"schemaVersion": 2, "mediaType": MANIFEST, "config": _descriptor(CONFIG, config_digest, config_size), "layers": [_descriptor(LAYER, x["digest"], x["size"]) for x in stack], "annotations": notes}


def platform(source: dict) -> dict:
    return {k: source[k] for k in ("architecture", "os", "variant", "os.version", "os.features") if source.get(k) is not None}


def index(images: list[dict], t0: int) -> dict:
    """images: manifest_digest, manifest_size, config and tags of each; an entry for each tag."""
    out = []
    for x in images:
        for tag in x["tags"] or [None]:
            notes = {CREATED: created(t0)} | ({REF_NAME: tag} if tag else {})
            out.append(_descriptor(MANIFEST, x["manifest_digest"], x["manifest_size"], platform=platform(x["config"]), annotations=notes))
    return {"schemaVersion": 2, "mediaType": INDEX, "manifests": out}


def docker_manifest(images: list[dict]) -> list[dict]:
    """One entry for each image. images: config_digest, tags and stack of each."""
    blob = lambda digest: f"blobs/sha256/{digest}"
    return [
        {
            "Config": blob(x["config_digest"]),
            "RepoTags": list(x["tags"]),
            "Layers": [blob(s["digest"]) for s in x["stack"]],
            "LayerSources": {f"sha256:{s['digest']}": _descriptor(LAYER, s["digest"], s["size"]) for s in x["stack"]},
        }
        for x in images
    ]
