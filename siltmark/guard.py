"""Access to held-out data: locked unless opened on purpose."""

from __future__ import annotations

import re


class HeldOutAccessError(PermissionError):
    """Held-out data was asked for while it is locked."""


class HeldOutLock:
    """Locked unless opened on purpose, as a context manager."""

    def __init__(self) -> None:
        self.open = False

    def __enter__(self) -> HeldOutLock:
        self.open = True
        return self

    def __exit__(self, *_: object) -> None:
        self.open = False


LOCK = HeldOutLock()


def is_held_out(path: str) -> bool:
    """The file name starts with `test`, or a folder is called `test` or `split=test`."""
    parts = [p for p in re.split(r"[/\\]", path.lower()) if p]
    return bool(parts) and (parts[-1].startswith("test") or any(p in ("test", "split=test") for p in parts))


def guarded(path: str) -> str:
    if is_held_out(path) and not LOCK.open:
        raise HeldOutAccessError(f"{path} is held out; open guard.LOCK to read it")
    return path
