"""Settings with the checks that make them valid, as records that go to JSON and come back with their types."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class DataSettings:
    historical_days: int = 252
    interval: str = "1d"

    def problems(self) -> list[str]:
        return [] if 20 <= self.historical_days <= 365 else ["historical_days must be from 20 to 365"]


@dataclass
class ScreenSettings:
    min_price: float = 50.0
    max_price: float = 500.0
    min_change: float = 0.03
    max_change: float = 0.07
    min_rsi: float = 40.0
    max_rsi: float = 70.0
    volume_surge: float = 1.5

    def problems(self) -> list[str]:
        out = [f"min_{x} must be below max_{x}" for x in ("price", "change", "rsi") if getattr(self, f"min_{x}") >= getattr(self, f"max_{x}")]
        return out + (["volume_surge must be 1 or more"] if self.volume_surge < 1 else [])


@dataclass
class ModelSettings:
    weights: dict[str, float] = field(default_factory=lambda: {"pattern": 0.3, "forecast": 0.25, "technical": 0.2, "sentiment": 0.15, "volume": 0.1})
    lookback: int = 60
    threshold: float = 0.7

    def problems(self) -> list[str]:
        out = [] if abs(sum(self.weights.values()) - 1) <= 0.01 else ["weights must sum to 1"]
        out += [] if self.lookback >= 20 else ["lookback must be 20 or more"]
        return out + ([] if 0 <= self.threshold <= 1 else ["threshold must be from 0 to 1"])


@dataclass
class ServiceSettings:
    """Keys come from the caller, for example from its environment; they are never read here."""

    news_key: str | None = None
    bars_key: str | None = None
    delay_ms: int = 100
    news_per_minute: int = 100

    def problems(self) -> list[str]:
        return ["news_key is too short"] if self.news_key and len(self.news_key) < 10 else []


@dataclass
class TradingSettings:
    max_positions: int = 20
    position_share: float = 0.05
    stop_loss: float = 0.05
    take_profit: float = 0.15
    trailing_stop: float = 0.03
    min_score: float = 70.0
    strong_score: float = 85.0

    def problems(self) -> list[str]:
        out = ["position_share above 0.1 is risky"] if self.position_share > 0.1 else []
        out += ["stop_loss above 0.1 is too high"] if self.stop_loss > 0.1 else []
        return out + ([] if 0 <= self.min_score <= 100 else ["min_score must be from 0 to 100"])


@dataclass
class NoticeSettings:
    mail: bool = False
    mail_server: str | None = None
    chat: bool = False
    chat_hook: str | None = None
    report_format: str = "pdf"

    def problems(self) -> list[str]:
        out = ["mail needs a mail_server"] if self.mail and not self.mail_server else []
        return out + (["chat needs a chat_hook"] if self.chat and not self.chat_hook else [])


LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass
class SystemSettings:
    environment: str = "development"
    log_level: str = "INFO"
    workers: int = 4
    chunk: int = 50

    def problems(self) -> list[str]:
        out = [] if self.log_level in LOG_LEVELS else [f"log_level must be one of {', '.join(LOG_LEVELS)}"]
        return out + ([] if 1 <= self.workers <= 16 else ["workers must be from 1 to 16"])


@dataclass
class Settings:
    data: DataSettings = field(default_factory=DataSettings)
    screen: ScreenSettings = field(default_factory=ScreenSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    trading: TradingSettings = field(default_factory=TradingSettings)
    notices: NoticeSettings = field(default_factory=NoticeSettings)
    system: SystemSettings = field(default_factory=SystemSettings)
    services: ServiceSettings = field(default_factory=ServiceSettings)

    def by_section(self) -> dict[str, list[str]]:
        """Problems by section, those between sections under "across"; sections without problems are left out."""
        out = {name: section.problems() for name, section in vars(self).items()}
        out["across"] = ["lookback must not exceed historical_days"] if self.model.lookback > self.data.historical_days else []
        return {name: found for name, found in out.items() if found}

    def problems(self) -> list[str]:
        return [x for found in self.by_section().values() for x in found]

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Sections or values that the file lacks have their defaults."""
        x = json.loads(Path(path).read_text())
        return cls(**{f.name: f.default_factory(**x.get(f.name, {})) for f in fields(cls)})


def ensemble_score(model: ModelSettings):
    """The weighted sum of columns named as the weights (an extension: nothing applies the weights otherwise)."""
    from pyspark.sql import functions as F

    return sum((F.coalesce(F.col(name), F.lit(0.0)) * w for name, w in model.weights.items()), F.lit(0.0))
