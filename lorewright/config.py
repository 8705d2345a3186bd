"""Engine parameters, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CharacterConfig:
    accept: float = 0.85
    review: float = 0.60
    candidates: int = 6
    active_window: int = 12
    prompt_version: str = "v2"

    def __post_init__(self) -> None:
        if not 0 <= self.review <= self.accept <= 1:
            raise ValueError("0 <= review <= accept <= 1 must hold")
        if not 1 <= self.candidates <= 12 or self.active_window < 1:
            raise ValueError("candidates must be 1..12 and the window positive")


@dataclass(frozen=True)
class SpeechConfig:
    provider: str = "local"
    chunk_chars: int = 400
    segment_ms: int = 180
    paragraph_ms: int = 320
    speaker_ms: int = 260
    scene_ms: int = 1000
    chapter_ms: int = 700

    def __post_init__(self) -> None:
        if not 80 <= self.chunk_chars <= 2000:
            raise ValueError("chunk_chars must be 80..2000")
        if min(self.segment_ms, self.paragraph_ms, self.speaker_ms, self.scene_ms, self.chapter_ms) < 0:
            raise ValueError("pauses can't be negative")
