"""Thresholds of the layout rules, by profile."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """The browser's values are the defaults; see ``CLI`` for the others."""

    page_width: int = 1000
    page_height: int = 1500
    frame_floor: float = 0.02
    balloon_floor: float = 0.25
    text_floor: float = 0.05
    text_model_floor: float = 0.3
    panel_conf: float = 0.25
    rescue_conf: float = 0.08
    rescue_area: float = 0.1
    rescue_overlap: float = 0.2
    sure_panel: float = 0.5
    min_panel_area: float = 0.02
    dedupe_iou: float = 0.6
    merge_iou: float = 0.4
    text_area: float = 0.04
    sure_text_area: float = 0.12
    sure_text: float = 0.7
    boxed_text: float = 0.6
    whole_share: float = 0.75
    clear_share: float = 0.5
    shared_share: float = 0.25
    enter_ms: int = 450
    reveal_ms: int = 300
    tail_ms: int = 600
    read_min_ms: int = 250
    read_max_ms: int = 1600
    read_per_ink: int = 160_000

    @property
    def page_area(self) -> int:
        return self.page_width * self.page_height


BROWSER = Profile()
CLI = replace(BROWSER, frame_floor=0.25, rescue_conf=0.25, text_floor=0.12, text_model_floor=0.12, reveal_ms=420, read_min_ms=650, read_max_ms=2800, read_per_ink=240_000)
