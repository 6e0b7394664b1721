"""Settings of the bid pipeline, with the benchmark's defaults, and the run names that carry them."""

from __future__ import annotations

from dataclasses import dataclass

WINDOWS, AGGREGATES, PROFILES = ("tumbling", "sliding", "session"), ("sum", "avg", "count", "max", "min"), ("constant", "step", "sine")


@dataclass(frozen=True)
class PipelineConfig:
    """Unknown names of a window, aggregate or profile raise ValueError. With hot_keys, sessions of static rows are found in parts."""

    high_value: bool = True
    min_price: float = 100.0
    auction_range: bool = False
    max_auction: int = 500
    bidder_range: bool = False
    max_bidder: int = 5000
    to_eur: bool = True
    eur_per_usd: float = 0.908
    window: str = "tumbling"
    aggregate: str = "sum"
    size: str = "10 seconds"
    slide: str = "5 seconds"
    gap: str = "30 seconds"
    lateness: str = "5 seconds"
    hot_keys: bool = False
    console_sink: bool = True
    file_sink: bool = False
    output_path: str = ""
    profile: str = "constant"
    rate: int = 50_000
    duration: int = 300
    step_low: float = 0.25
    step_high: float = 1.5
    step_from: float = 0.33
    step_to: float = 0.66
    sine_amplitude: float = 0.7
    sine_period: int = 60
    cpu_load: int = 0
    parallelism: int = 4

    def __post_init__(self) -> None:
        for value, known in ((self.window, WINDOWS), (self.aggregate, AGGREGATES), (self.profile, PROFILES)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")

    @classmethod
    def from_args(cls, args: list[str]) -> PipelineConfig:
        """rate, duration, parallelism, window seconds, CPU load and profile, in this order, from the first on as many as there are."""
        names = ("rate", "duration", "parallelism", "size", "cpu_load", "profile")
        given = dict(zip(names, args, strict=False))
        read = {"size": lambda v: f"{int(v)} seconds", "profile": str.lower}
        return cls(**{name: read.get(name, int)(value) for name, value in given.items()})

    @property
    def source_parallelism(self) -> int:
        return max(1, self.parallelism // 2)

    @property
    def sink_parallelism(self) -> int:
        return max(1, self.parallelism // 4)

    def run_name(self) -> str:
        # fixed value: the format of the benchmark's run names
        profile = "" if self.profile == "constant" else f",dist={self.profile.upper()}"
        return f"Nexmark-Config[rate={self.rate // 1000}k,par={self.parallelism},win={self.window[:3].upper()}-{self.size.split()[0]}s,cpu={self.cpu_load}{profile}]"
