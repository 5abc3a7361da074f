"""Job parameters, with the bounds every job relies on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Allowed settings and hard limits of the data flow.
GOLDEN_SET_MODES = ("auto", "manual")
CHANNELS = ("telegram", "webhook", "none")
PROVIDERS = ("openai", "anthropic")
ROLES = ("system", "user", "assistant", "tool")
SCORE_WINDOW = 50
MIN_SCORES = 10
SPLIT_MIN_N = 4
SPLIT_ROUNDS = 10
LATENCY_BUCKETS_MS = (50, 100, 250, 500, 1000, 2000, 5000)


@dataclass(frozen=True)
class Params:
    sampling_rate: int = 10
    golden_set_mode: str = "auto"
    golden_set_warmup: int = 100
    drift_threshold: float = 0.15
    birch_threshold: float = 0.25
    ann_candidates: int = 10
    max_batch: int = 32
    max_wait_ms: int = 200
    max_delivery_attempts: int = 3
    detection_interval_s: int = 600
    split_interval_s: int = 3600
    recovery_interval_s: int = 300
    recovery_min_age_s: int = 300
    notification_channel: str = "none"
    telegram_bot_token: str = field(default="", repr=False)
    telegram_chat_id: str = ""
    webhook_url: str = ""
    webhook_secret: str = field(default="", repr=False)
    alert_title: str = "Quality drift alert"
    embedding_dim: int = 384
    # Largest centroid matrix (or split state) sent whole to every executor;
    # larger ones take the partitioned path.
    broadcast_limit_bytes: int = 128 << 20
    # Rows one grouped task may hold in the grower and in the cell search.
    group_rows: int = 2000
    # Score evaluation may see the response's own golden entry.
    exclude_self: bool = False

    def __post_init__(self) -> None:
        _at_least("sampling_rate", self.sampling_rate, 1)
        _at_least("golden_set_warmup", self.golden_set_warmup, 1)
        _inside("drift_threshold", self.drift_threshold)
        _inside("birch_threshold", self.birch_threshold)
        _between("ann_candidates", self.ann_candidates, 1, 100)
        _between("max_batch", self.max_batch, 1, 32)
        _at_least("max_wait_ms", self.max_wait_ms, 10)
        _at_least("max_delivery_attempts", self.max_delivery_attempts, 1)
        for name in ("detection_interval_s", "split_interval_s", "recovery_interval_s"):
            _at_least(name, getattr(self, name), 60)
        _at_least("recovery_min_age_s", self.recovery_min_age_s, 30)
        _at_least("embedding_dim", self.embedding_dim, 1)
        # A grower group holds two group_rows x group_rows matrices in a worker.
        _between("group_rows", self.group_rows, 2, 4000)
        if self.golden_set_mode not in GOLDEN_SET_MODES:
            raise ValueError(f"golden_set_mode must be one of {GOLDEN_SET_MODES}")
        if self.notification_channel not in CHANNELS:
            raise ValueError(f"notification_channel must be one of {CHANNELS}")
        if self.notification_channel == "telegram" and not (
            self.telegram_bot_token and self.telegram_chat_id
        ):
            raise ValueError("the telegram channel needs a bot token and a chat id")
        if self.notification_channel == "webhook" and not self.webhook_url:
            raise ValueError("the webhook channel needs a URL")


def _at_least(name: str, value: int, low: int) -> None:
    if value < low:
        raise ValueError(f"{name} must be at least {low}, got {value}")


def _between(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, got {value}")


def _inside(name: str, value: float) -> None:
    if not 0.0 < value < 1.0:
        raise ValueError(f"{name} must lie strictly between 0 and 1, got {value}")
