"""Options of a packing run, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_GZIP_LEVEL = 6
GZIP_LEVELS = range(1, 10)


@dataclass(frozen=True)
class BundleOptions:
    """What to keep, how to decode it and how to write it.

    ``exclude`` replaces the default exclusions (an empty tuple switches them
    off), ``extend_exclude`` adds to them and is ignored when ``exclude`` is
    given. A ``gzip_level`` outside 1-9 falls back to the default.
    """

    utf8: bool = False
    line_numbers: bool = False
    exclude: tuple[str, ...] | None = None
    extend_exclude: tuple[str, ...] | None = None
    gzip: bool = False
    gzip_level: int = DEFAULT_GZIP_LEVEL
    model: str = "gpt4o"
    on_bad_path: str = "fail"

    def __post_init__(self) -> None:
        if self.on_bad_path not in ("fail", "quarantine"):
            raise ValueError("on_bad_path must be 'fail' or 'quarantine'")
        if self.gzip_level not in GZIP_LEVELS:
            object.__setattr__(self, "gzip_level", DEFAULT_GZIP_LEVEL)
        for name in ("exclude", "extend_exclude"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise TypeError(f"{name} takes a sequence of patterns, not one string")
            if value is not None:
                object.__setattr__(self, name, tuple(value))
