"""Detection options. Those that change nothing in the classic behaviour take effect with ``extended``."""

from __future__ import annotations

from dataclasses import dataclass

SENSITIVITIES = ("low", "medium", "high", "custom")
SEARCH_RANGES = ("auto", "small", "medium", "large")
FORMATS = ("json", "csv", "aegisub", "txt", "timecode", "tc", "edl")


@dataclass(frozen=True)
class Options:
    """``sensitivity``, custom thresholds and smoothing are accepted always and applied only with ``extended``."""

    sensitivity: str = "medium"
    search_range: str = "medium"
    skip_frames: int = 0
    intra_thresh: int | None = None
    intra_thresh2: int | None = None
    smoothing_window: int = 0
    smoothing_min: int = 1
    progressive: bool = False
    workers: int | None = None
    pixel_format: str = "gray"
    format: str = "json"
    extended: bool = False
    chunk_bytes: int = 64 << 20  # frame bytes that one task scores at once

    def __post_init__(self) -> None:
        for name, known in (("sensitivity", SENSITIVITIES), ("search_range", SEARCH_RANGES), ("format", FORMATS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {', '.join(known)}")
        if self.skip_frames < 0:
            raise ValueError("skip_frames must not be negative")
        if self.pixel_format != "gray":
            raise ValueError("only gray frames are scored")

    def thresholds(self) -> tuple[int, int]:
        """Base thresholds of the intra test and of the frame score."""
        if not self.extended:
            return 2000, 90
        base = {"low": (3000, 150), "high": (1000, 50)}.get(self.sensitivity, (2000, 90))
        return self.intra_thresh if self.intra_thresh is not None else base[0], self.intra_thresh2 if self.intra_thresh2 is not None else base[1]
