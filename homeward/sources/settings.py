"""Settings of a run, checked once. Nothing reads the environment but ``Settings.of``."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from homeward import config as C


@dataclass(frozen=True)
class Settings:
    """What may be switched: mock answers, where galleries come from and how long they are kept,
    how many matches are shown, whether texts count, and how long a map is waited for."""

    mock: bool = False
    gallery_source: str = "table"
    gallery_seconds: float = 300.0
    top_k: int = C.TOP_K
    text_rerank: bool = False
    map_timeout: float = 10.0

    def __post_init__(self) -> None:
        if self.gallery_source not in ("table", "cache"):
            raise ValueError("galleries come from a table or from a cache")
        if not (math.isfinite(self.map_timeout) and self.map_timeout > 0):
            raise ValueError("the map's timeout must be a finite number above 0")
        if self.gallery_seconds < 0 or not 1 <= self.top_k <= 20:
            raise ValueError("galleries are kept for 0 seconds or more; 1 to 20 matches can be shown")

    @property
    def weights(self) -> dict[str, float]:
        return C.TEXT_RERANK_WEIGHTS if self.text_rerank else C.RERANK_WEIGHTS

    @staticmethod
    def of(env: Mapping[str, str]) -> Settings:
        """From variables named HOMEWARD_ and the setting's name in capitals."""
        found = {k.removeprefix("HOMEWARD_").lower(): v for k, v in env.items() if k.startswith("HOMEWARD_")}
        made: dict[str, object] = {}
        for name, kind in (("mock", bool), ("gallery_source", str), ("gallery_seconds", float), ("top_k", int), ("text_rerank", bool), ("map_timeout", float)):
            if name in found:
                made[name] = found[name].strip().lower() == "true" if kind is bool else kind(found[name])
        return Settings(**made)


class Galleries:
    """Galleries by species, read again once they are older than the settings allow."""

    def __init__(self, settings: Settings, read, clock):
        self.settings, self.read, self.clock, self.held = settings, read, clock, {}

    def get(self, species: str):
        made, df = self.held.get(species, (None, None))
        if made is None or self.clock() - made > self.settings.gallery_seconds:
            if df is not None:
                df.unpersist()
            made, df = self.clock(), self.read(species).persist()
            self.held[species] = (made, df)
        return df
