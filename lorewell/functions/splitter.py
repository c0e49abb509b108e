"""Recursive splitting of one long text by ever finer separators."""

from __future__ import annotations

from .links import protect_images, restore_images

# The separators, coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", " ", "")


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of the text, each but the first beginning with the separator."""
    if not sep:
        return list(text)
    first, *rest = text.split(sep)
    return [p for p in (first, *(sep + r for r in rest)) if p]


def split_text(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` code points without outer blanks; small neighbours are joined greedily, no overlap."""
    at = next(i for i, s in enumerate(separators) if s in text)
    finer = separators[at + 1 :]
    done: list[str] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run.strip():
            done.append(run.strip())
        run = ""

    for piece in _cut(text, separators[at]):
        if len(piece) >= size:
            close()
            if len(piece) == size or not finer:
                done.extend([piece.strip()] if piece.strip() else [])
            else:
                done += split_text(piece, size, finer)
            continue
        if len(run) + len(piece) > size:
            close()
        run += piece
    close()
    return done


def split_body(body: str, size: int) -> list[str]:
    """As ``split_text``, but no image is cut in two; one longer than ``size`` makes its piece longer."""
    text, images = protect_images(body)
    return [restore_images(p, images) for p in split_text(text, size)]
