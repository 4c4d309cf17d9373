"""Policies of the file caches, as pure functions, and JSON records of a universe."""

from __future__ import annotations

import json
import time
from pathlib import Path


def age_hours(path: str | Path) -> float:
    p = Path(path)
    return (time.time() - p.stat().st_mtime) / 3600 if p.exists() else float("inf")


def universe_is_fresh(age: float, max_age_days: int = 7) -> bool:
    """Age in hours; whole days count."""
    return age != float("inf") and int(age // 24) < max_age_days


def bars_are_fresh(age: float, interval: str = "1d") -> bool:
    return age < (24 if interval.endswith(("d", "wk", "mo")) else 1)


def usable(age: float, interval: str = "1d", failed: bool = False) -> bool:
    """Whether a cached file is served: a fresh one, and any there is if fetching has failed."""
    return bars_are_fresh(age, interval) or (failed and age != float("inf"))


def key(ticker: str, interval: str, *span: str) -> str:
    """Distinct for distinct tickers: dashes stay."""
    return "_".join([ticker, interval, *span])


def write_universe(path: str | Path, tickers: list[str], companies: list[dict] | None = None, updated: str = "") -> None:
    """Companies that were known stay if none are given."""
    old = read_universe(path) if Path(path).exists() else {}
    Path(path).write_text(json.dumps({"tickers": tickers, "companies": companies if companies is not None else old.get("companies", []), "updated": updated, "count": len(tickers)}))


def read_universe(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def clear(folder: str | Path, older_than_hours: float | None = None) -> int:
    """Delete cached files, all of them only if no age is given."""
    gone = [p for p in Path(folder).glob("*") if p.is_file() and (older_than_hours is None or age_hours(p) > older_than_hours)]
    for p in gone:
        p.unlink()
    return len(gone)
