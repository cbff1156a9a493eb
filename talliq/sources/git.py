"""The branch that a folder is on, read from its repository's files."""

from __future__ import annotations

from pathlib import Path


def branch(folder: str) -> str | None:
    """The branch of the nearest repository at or above a folder; seven characters of a detached head; None without."""
    here = Path(folder)
    for at in (here, *here.parents):
        marker = at / ".git"
        try:
            if marker.is_dir():
                return _head(marker)
            if marker.is_file():
                text = marker.read_text()
                return _head(Path(text.removeprefix("gitdir:").strip())) if text.startswith("gitdir:") else None
        except (OSError, UnicodeDecodeError):
            return None
    return None


def _head(git: Path) -> str | None:
    try:
        head = (git / "HEAD").read_text().strip()
    except (OSError, UnicodeDecodeError):
        return None
    if head.startswith("ref: refs/heads/"):
        return head.removeprefix("ref: refs/heads/")
    return head[:7] if len(head) >= 7 else None
