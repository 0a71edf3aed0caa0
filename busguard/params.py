"""Detector parameters: one dataclass, defaults equal to the reference detector."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

NS_PER_S = 1_000_000_000
NS_PER_MS = 1_000_000


@dataclass(frozen=True)
class DetectorParams:
    # --- warm-up and model (fixed values of the reference) ---
    warmup_samples: int = 1000
    contamination: float = 0.03
    n_trees: int = 200
    seed: int = 42
    min_warmup_bus_frequency: float = 100.0
    # --- timing baseline ---
    baseline_min_timing_samples: int = 30
    exactness_cv_ratio: float = 0.35
    iat_robust_z: float = 4.0
    baseline_sample_cap: int = 1000
    # --- payload repeats and replay ---
    repeat_window_ns: int = 3 * NS_PER_S
    repeat_min_count: int = 4
    replay_composite: float = 0.30
    rare_replay_floor: float = 0.25
    severe_model_score: float = -0.13
    ngram_length: int = 3
    ngram_min_repeats: int = 2
    ngram_tight_ratio: float = 0.65
    replay_suspicion_age_ns: int = 500 * NS_PER_MS
    # --- traffic ---
    traffic_window_ns: int = NS_PER_S
    bus_capacity_per_s: float = 5000.0
    # --- transitions ---
    transition_min_total: int = 20
    transition_alpha: float = 0.5
    transition_rare_below: float = 0.02
    # --- frame of the rolling gap statistics (W10) ---
    interarrival_rows: int = 300
    # --- optional bounds on windows, None = none: they make counts saturate with traffic (see MEMORY_BOUNDS) ---
    id_arrival_cap: int | None = None
    bus_arrival_cap: int | None = None
    signature_time_cap: int | None = None
    ngram_sighting_cap: int | None = None
    replay_suspicion_cap: int | None = None
    # --- ours: data layout and streaming ---
    bus_keys: tuple[str, ...] = ("vehicle_id",)
    chunk_ns: int = 20 * NS_PER_S      # grid of time chunks that splits a bus into parallel tasks
    chunk_rows: int = 200_000          # rows of one chunk's task: busier cells of the grid are cut further
    block_rows: int = 50_000           # row block that splits one identifier's sequence
    use_model: bool = True
    arrival_ties: bool = False         # True: equal event times count in arrival order, not as peers
    state_ttl_ms: int = 0              # 0 = keep signature / 3-gram state forever (reference)
    known_ids: tuple[str, ...] = field(default=("0x110", "0x220", "0x330", "0x440", "0x550"))

    @property
    def halo_ns(self) -> int:
        """Trailing reach every time window needs from the previous chunk."""
        return max(self.repeat_window_ns, self.traffic_window_ns + self.replay_suspicion_age_ns)

    def with_(self, **kw) -> "DetectorParams":
        return replace(self, **kw)


DEFAULT = DetectorParams()
# The memory bounds of a single detector process, for parity runs:
# ``params.with_(**MEMORY_BOUNDS)``.  Above them counts saturate and the bus window loses its oldest frames.
MEMORY_BOUNDS = {"id_arrival_cap": 3000, "bus_arrival_cap": 10000, "signature_time_cap": 200,
                 "ngram_sighting_cap": 100, "replay_suspicion_cap": 1000}
# Parity with the reference: every frame of the process shares one bus.
REFERENCE_BUS = DetectorParams(bus_keys=())
