"""Column-name cleaning. Names are metadata, so this runs on the driver over the header only."""

from __future__ import annotations

import re
import unicodedata

_NON_WORD = re.compile(r"[^A-Za-z0-9_]+")


def sanitize_identifier(name: str | None) -> str:
    """NFKD-normalise, turn every run of non-word characters into ``_``, strip outer ``_``,
    lower-case; an empty result becomes ``col``."""
    text = unicodedata.normalize("NFKD", name or "")
    text = _NON_WORD.sub("_", text).strip("_").lower()
    return text or "col"


def unique_names(names: list[str]) -> list[str]:
    """Second ``x`` becomes ``x_2``, third ``x_3``; keeps counting past names already taken."""
    taken: set[str] = set()
    seen: dict[str, int] = {}
    out = []
    for name in names:
        count = seen.get(name, 0) + 1
        seen[name] = count
        candidate = name if count == 1 else f"{name}_{count}"
        while candidate in taken:
            count += 1
            seen[name] = count
            candidate = f"{name}_{count}"
        taken.add(candidate)
        out.append(candidate)
    return out


def header_names(raw: list[str | None]) -> list[str]:
    """Header cells → clean, unique column names (an empty cell starts as ``column``)."""
    cleaned = [sanitize_identifier(c if (c or "").strip() else "column") for c in raw]
    return unique_names(cleaned)
