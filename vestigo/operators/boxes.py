"""An index of boxes by size and place, for work that meets kept boxes one by one."""

from __future__ import annotations

import math
from collections.abc import Iterator

Box = tuple[float, float, float, float]


def overlap_share(a: Box, b: Box) -> float:
    """Intersection over union; 0 for boxes that only touch or have no area."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


class BoxIndex:
    """Boxes by number, found by overlap of at least `threshold` (above 0).

    A box lives at the level of its longer side (a power of two) in the one cell that holds its
    corner. Overlapping boxes have sides within 1/threshold of each other, so a search reads few
    levels, and there the cells whose boxes can reach it. While there are few boxes it reads them all.
    """

    FEW = 24

    def __init__(self, threshold: float):
        if not 0.0 < threshold <= 1.0:
            raise ValueError("an overlap threshold lies above 0, up to 1")
        self.threshold = threshold
        self.levels_apart = math.ceil(-math.log2(threshold)) + 1
        self.boxes: dict[int, Box] = {}
        self.cells: dict[tuple[int, int, int], list[int]] = {}
        self.at_level: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.boxes)

    @staticmethod
    def _place(box: Box) -> tuple[int, int, int] | None:
        side = max(box[2] - box[0], box[3] - box[1])
        if not (side > 0 and math.isfinite(side)):
            return None  # overlaps nothing
        level = math.frexp(side)[1]
        pitch = math.ldexp(1.0, level)
        return level, math.floor(box[0] / pitch), math.floor(box[1] / pitch)

    def put(self, number: int, box: Box) -> None:
        """Adds a box, or moves the one of that number."""
        self.drop(number)
        self.boxes[number] = box
        place = self._place(box)
        if place is not None:
            self.cells.setdefault(place, []).append(number)
            self.at_level[place[0]] = self.at_level.get(place[0], 0) + 1

    def drop(self, number: int) -> None:
        box = self.boxes.pop(number, None)
        place = None if box is None else self._place(box)
        if place is not None:
            here = self.cells[place]
            here.remove(number)
            self.at_level[place[0]] -= 1
            if not here:
                del self.cells[place]

    def near(self, box: Box) -> Iterator[int]:
        """Numbers of the boxes that may overlap this one enough; each once, in no order."""
        place = self._place(box)
        if place is None:
            return
        if len(self.boxes) <= self.FEW:
            yield from self.boxes
            return
        for level in range(place[0] - self.levels_apart, place[0] + self.levels_apart + 1):
            if not self.at_level.get(level):
                continue
            pitch = math.ldexp(1.0, level)
            columns = range(math.floor(box[0] / pitch) - 1, math.floor(box[2] / pitch) + 1)
            rows = range(math.floor(box[1] / pitch) - 1, math.floor(box[3] / pitch) + 1)
            for x in columns:
                for y in rows:
                    yield from self.cells.get((level, x, y), ())

    def overlapping(self, box: Box) -> list[int]:
        """Numbers of the boxes that overlap this one enough, rising."""
        return sorted(n for n in self.near(box) if overlap_share(box, self.boxes[n]) >= self.threshold)

    def first(self, box: Box) -> int | None:
        """Lowest number of those."""
        return min((n for n in self.near(box) if overlap_share(box, self.boxes[n]) >= self.threshold), default=None)

    def meets(self, box: Box) -> bool:
        return any(overlap_share(box, self.boxes[n]) >= self.threshold for n in self.near(box))
