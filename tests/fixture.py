"""The small frame tree of FIXTURES.md."""

from __future__ import annotations

import os


def pixels(v: int, f: int, w: int, h: int) -> bytes:
    off = 45 * (f // 3) + 2 * (f % 3) if v == 0 else 5 * f
    return bytes(min(255, (x * (3 + v) + y * 5 + ch * 17) % 97 + off) for y in range(h) for x in range(w) for ch in range(3))


def write(root: str, w: int, h: int) -> str:
    """Four folders, one of them empty; returns the query frame's path."""
    for name, frames in (("video_a", [(0, f) for f in range(9)]), ("video_b_empty", []), ("video_c", [(1, f) for f in range(12)]), ("video_d", [(1, 11)] * 4)):
        os.makedirs(f"{root}/tree/{name}")
        for i, (v, f) in enumerate(frames):
            with open(f"{root}/tree/{name}/frame_{i + 1:06d}.raw", "wb") as out:
                out.write(pixels(v, f, w, h))
    query = f"{root}/query.raw"
    with open(query, "wb") as out:
        out.write(bytes(min(255, b + 1) for b in pixels(0, 4, w, h)))
    return query
