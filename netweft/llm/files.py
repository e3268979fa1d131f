"""Files that tasks write under a name of their own attempt."""
from __future__ import annotations

from pyarrow import fs


def settle(store: fs.FileSystem, draft: str, final: str) -> None:
    """Gives a draft its final name. If another attempt was first, its file, which has the same bytes, stays."""

    def size() -> int | None:
        info = store.get_file_info(final)
        return info.size if info.type != fs.FileType.NotFound else None

    if size() is None:
        try:
            return store.move(draft, final)
        except OSError:  # some stores refuse a name that has been given meanwhile
            if size() is None:
                raise
    if size() != store.get_file_info(draft).size:
        raise OSError(f"{final} is there and is not the same file")
    store.delete_file(draft)
