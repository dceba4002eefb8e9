"""Settings of an alignment run."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class AlignConfig:
    """Defaults of the aligner; immutable, so that it can be captured by any task."""

    preset: str = "en-us"
    lang: str = "en-us"
    duration_max_s: float = 30.0
    silence_anchors: int = 10
    boost_targets: bool = True
    boost: float = 5.0
    enforce_minimum: bool = True
    enforce_all_targets: bool = True
    ensure_completeness: bool = False
    ignore_noise: bool = True
    extend_soft_boundaries: bool = True
    boundary_softness: int = 3
    bad_confidence_threshold: float = 0.6
    sample_rate: int = 16_000
    min_segment_s: float = 0.05
    min_targets: int = 1
    window_ms: int = 120
    stride_ms: int = 80
    silence_id: int = 0
    blank_id: int = 66
    blank_group: int = 16
    silence_threshold: float = 0.9
    boundary_pad: int = 3
    min_speech_frames: int = 20
    max_blanks: int = 10
    # Fixed values of the decoding between silences: targets of a long text, and for these a lower
    # threshold (1 less so much for each frame of width, this at least) and a narrower width; strides
    # with the part of the frames that a path of the wider one may take; the longest path, as a part of
    # the frames; states of a path from which on it is banded.
    long_text: int = 200
    threshold_step: float = 0.09
    least_threshold: float = 0.05
    narrow_silence: int = 3
    narrower: tuple[tuple[int, float], ...] = ((3, 0.9), (2, 0.8))
    most_path: float = 1.2
    band_from: int = 60

    def for_groups(self) -> AlignConfig:
        """The same for the group track, whose blank is the group of noise."""
        return replace(self, blank_id=self.blank_group)
