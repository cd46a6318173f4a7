"""Cuts a stream of speech probabilities into segments.

Works on counts of samples, so all framing is exact. ``Segmenter.frame`` takes one window's
probability; a segment is (first sample, end sample, starts with a replay).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from ..params import DEFAULT, Params


@dataclass
class SegmentMemory:
    #: sample where the buffer starts, and its length
    start: int = 0
    size: int = 0
    speaking: bool = False
    spoken: bool = False
    silent: int = 0
    replay: bool = False
    #: length of the buffer at its latest quiet window; -1: none
    quiet: int = -1

    def dump(self) -> dict:
        return asdict(self)


class Segmenter:
    def __init__(self, memory: SegmentMemory | None = None, p: Params = DEFAULT, max_sec: float | None = None, silence_sec: float | None = None):
        self.m, self.p = memory or SegmentMemory(), p
        self.longest = int((p.segment_max_sec if max_sec is None else max_sec) * p.sample_rate)
        self.pause = int((p.silence_cut_sec if silence_sec is None else silence_sec) * p.sample_rate)
        self.overlap = int(p.overlap_sec * p.sample_rate)
        self.lookback = int(p.quiet_lookback_sec * p.sample_rate)

    def frame(self, probability: float) -> tuple[int, int, bool] | None:
        m, p = self.m, self.p
        m.size += p.frame
        if probability >= p.speech_on:
            m.speaking = m.spoken = True
        elif probability < p.speech_off:
            m.speaking, m.quiet = False, m.size
        m.silent = 0 if m.speaking else m.silent + p.frame
        if m.spoken and not m.speaking and m.silent >= self.pause:
            return self._close(m.size, keep_from=m.size, replay=False, spoken=False)
        if m.size < self.longest:
            return None
        if not m.spoken:
            m.start, m.size = m.start + m.size, 0  # nothing but silence
            return None
        if m.quiet >= m.size - self.lookback and m.quiet > self.overlap:
            return self._close(m.quiet, keep_from=m.quiet, replay=False, spoken=True)
        return self._close(m.size, keep_from=m.size - self.overlap, replay=True, spoken=True)

    def flush(self) -> tuple[int, int, bool] | None:
        if self.m.spoken and self.m.size:
            return self._close(self.m.size, keep_from=self.m.size, replay=False, spoken=False)
        self.m.start, self.m.size = self.m.start + self.m.size, 0
        return None

    def _close(self, end: int, keep_from: int, replay: bool, spoken: bool) -> tuple[int, int, bool]:
        m = self.m
        out = (m.start, m.start + end, m.replay)
        m.start, m.size = m.start + keep_from, m.size - keep_from
        m.replay, m.spoken, m.quiet, m.silent = replay, spoken, -1, 0
        return out
