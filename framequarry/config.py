"""Options and results of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Geometry:
    """Frames are interleaved bytes, row by row; channels is 3 (RGB) or 1 (grey)."""

    width: int = 1280
    height: int = 720
    channels: int = 3

    def __post_init__(self):
        if self.width < 8 or self.height < 8:
            raise ValueError("a frame is 8 by 8 pixels at least")
        if self.channels not in (1, 3):
            raise ValueError("a frame has 1 or 3 channels")
        if self.nbytes >= 1 << 31:
            raise ValueError("a frame is under 2 GiB")

    @property
    def nbytes(self) -> int:
        return self.width * self.height * self.channels


@dataclass(frozen=True)
class Config:
    """reset_on_video: the first frame of a video is always kept; edges: `truncate` leaves the pixels beyond 8 equal cells out, `absorb` adds them to the last cells."""

    geometry: Geometry = Geometry()
    chunk_frames: int = 1200
    dedup_threshold: float = 8000
    topk: int = 50
    dedup: bool = True
    reset_on_video: bool = False
    index_edge: str = "truncate"
    query_edge: str = "absorb"

    def __post_init__(self):
        for name in ("chunk_frames", "dedup_threshold", "topk"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be over 0")
        if not {self.index_edge, self.query_edge} <= {"truncate", "absorb"}:
            raise ValueError("an edge is truncate or absorb")


@dataclass(frozen=True)
class BuildStats:
    frames_total: int
    frames_after_dedup: int
    signatures_written: int


@dataclass(frozen=True)
class QueryResult:
    found: bool = False
    video_id: int = -1
    frame_id: int = -1
    best_db_index: int = -1
    dist: int = -1
    sad: int = -1
    score: float = 0.0
