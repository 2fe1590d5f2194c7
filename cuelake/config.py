"""Parameters of cue building, in two presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CueParams:
    similarity: float = 0.85
    line_similarity: float = 0.0
    merge_gap: float = 0.5
    step: float = 0.1
    least_duration: float = 0.5
    least_confidence: float = 0.5
    padding: float = 0.0
    flicker_similarity: float = 0.70
    path: bool = False
    open_cost: float = 0.35
    look_back: int = 30

    def with_(self, **changes) -> CueParams:
        return replace(self, **changes)


LIBRARY = CueParams()
APP = CueParams(similarity=0.80, line_similarity=0.75, merge_gap=0.6, step=0.08, least_duration=0.3, least_confidence=0.6)
