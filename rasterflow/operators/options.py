"""The knobs that change a result, as one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """Defaults are the format's usual ones; a record that cannot be honoured is refused when it is made."""

    quality: int = 80
    mode_search: bool = True
    split_modes: bool = True
    split_bias: float = 1.0
    rate_search: bool = True
    rate_strength: float = 0.35
    rate_weights: tuple[float, float, float] = (1.0, 1.0, 1.0)  # whole luma blocks, split luma, chroma
    kept_candidates: int = 0  # 0: all
    trellis_sweeps: int = 0  # 0: no trellis
    adapt: bool = True
    adapt_margin: float = 8.0
    quantiser_bias: float = 0.65
    skip_flags: bool = True
    skip_probability: int | None = None  # none: from the data
    step_deltas: tuple[int, int, int] = (0, 0, 0)  # luma dc, chroma dc, chroma ac
    alpha: str = "keep"
    alpha_filter: str = "auto"
    keep_profile: bool = True
    skip_webp: bool = True

    def __post_init__(self):
        checks = {
            "quality": 0 <= self.quality <= 100,
            "kept_candidates": 0 <= self.kept_candidates <= 10,
            "trellis_sweeps": self.trellis_sweeps >= 0,
            "quantiser_bias": 0 <= self.quantiser_bias <= 1,
            "skip_probability": self.skip_probability is None or 1 <= self.skip_probability <= 255,
            "step_deltas": len(self.step_deltas) == 3 and all(-15 <= d <= 15 for d in self.step_deltas),
            "rate_weights": len(self.rate_weights) == 3 and min(self.rate_weights) >= 0,
            "alpha": self.alpha in ("keep", "flatten", "fail"),
            "alpha_filter": self.alpha_filter in ("auto", "none", "horizontal", "vertical", "gradient"),
        }
        wrong = [name for name, good in checks.items() if not good]
        if wrong:
            raise ValueError(f"options out of range: {', '.join(wrong)}")

    @classmethod
    def of(cls, given: dict) -> Options:
        """From a mapping; an unknown name is refused."""
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**given)
