"""Deterministic tar records: ustar headers, and extended records for what doesn't fit."""

from __future__ import annotations

from lamina.errors import ValidationError

BLOCK, TRAILER = 512, bytes(1024)
#: The largest numbers in ustar fields, and type flags.
ID_MAX, SIZE_MAX, TIME_MAX = 0o7777777, 0o77777777777, 0o77777777777
FLAGS = {"Regular": b"0", "Hardlink": b"1", "Symlink": b"2", "CharDevice": b"3", "BlockDevice": b"4", "Directory": b"5", "Fifo": b"6", "Extended": b"x"}


def extended_record(key: bytes, value: bytes) -> bytes:
    """"length key=value\\n", where length counts the whole record."""
    rest = len(key) + len(value) + 3
    size = rest + len(str(rest))
    size = rest + len(str(size))
    return b"%d %s=%s\n" % (size, key, value)


def padding(size: int) -> bytes:
    return bytes(-size % BLOCK)


def _octal(value: int, width: int) -> bytes:
    return f"{value:0{width - 1}o}".encode() + b"\0"


def _split_name(name: bytes) -> tuple[bytes, bytes] | None:
    """(name, prefix) of at most 100 and 155 bytes, or None."""
    if len(name) <= 100:
        return name, b""
    for at in range(len(name) - 1, 0, -1):
        if name[at : at + 1] == b"/" and at <= 155 and 0 < len(name) - at - 1 <= 100:
            return name[at + 1 :], name[:at]
    return None


def _cut(name: bytes) -> bytes:
    """At most 100 bytes, whole characters of UTF-8."""
    head = name[:100]
    try:
        head.decode()
    except UnicodeDecodeError as e:
        head = head[: e.start]
    return head


def _header(name: bytes, kind: str, *, mode: int = 0, uid: int = 0, gid: int = 0, size: int = 0, mtime: int = 0, link: bytes = b"", major: int = 0, minor: int = 0) -> bytes:
    short, prefix = _split_name(name) or (_cut(name) or b"_long_name", b"")
    raw = bytearray(
        short.ljust(100, b"\0") + _octal(mode, 8) + _octal(uid, 8) + _octal(gid, 8) + _octal(size, 12) + _octal(mtime, 12) + b" " * 8
        + FLAGS[kind] + link[:100].ljust(100, b"\0") + b"ustar\x0000" + bytes(64) + _octal(major, 8) + _octal(minor, 8) + prefix.ljust(155, b"\0") + bytes(12)
    )
    raw[148:156] = f"{sum(raw):06o}".encode() + b"\0 "
    return bytes(raw)


def entry_head(path: bytes, kind: str, *, mode: int, uid: int, gid: int, size: int, mtime: int, link: bytes | None = None, rdev: tuple[int, int] | None = None, xattrs: list[tuple[bytes, bytes]] = ()) -> bytes:
    """All that stands before an entry's body. Only regular files have one; owners have numbers
    and no names; directories end in a slash."""
    if kind not in FLAGS or kind == "Extended":
        raise ValidationError(f"an entry of kind {kind} can't be written")
    name = path + b"/" if kind == "Directory" and not path.endswith(b"/") else path
    body = size if kind == "Regular" else 0
    records: list[tuple[bytes, bytes]] = []
    if _split_name(name) is None:
        records.append((b"path", name))
    if link is not None and len(link) > 100:
        records.append((b"linkpath", link))
    for key, value, most in ((b"uid", uid, ID_MAX), (b"gid", gid, ID_MAX), (b"size", body, SIZE_MAX)):
        if value > most:
            records.append((key, b"%d" % value))
    records += [(b"SCHILY.xattr." + k, v) for k, v in sorted(xattrs)]
    fits = lambda value, most: value if value <= most else 0
    major, minor = rdev or (0, 0)
    mtime = min(max(mtime, 0), TIME_MAX)
    head = _header(name, kind, mode=mode, uid=fits(uid, ID_MAX), gid=fits(gid, ID_MAX), size=fits(body, SIZE_MAX), mtime=mtime, link=_cut(link) if link and len(link) > 100 else link or b"", major=major, minor=minor)
    if not records:
        return head
    blob = b"".join(extended_record(k, v) for k, v in records)
    folder, _, base = path.rstrip(b"/").rpartition(b"/")
    shown = (folder + b"/" if folder else b"") + b"PaxHeaders/" + base
    return _header(shown, "Extended", mode=0o644, size=len(blob), mtime=mtime) + blob + padding(len(blob)) + head
