"""Pipeline and filter configuration from YAML or TOML."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from loomsieve.functions.language import LanguageConfig
from loomsieve.functions.quality import QualityConfig


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configuration needs PyYAML; use TOML") from e
    return yaml


@dataclass(frozen=True)
class Io:
    path: str
    format: str = "jsonl"
    compression: str = "none"

    def __post_init__(self) -> None:
        if self.format not in ("jsonl", "json", "parquet", "csv"):
            raise ValueError(f"unknown format {self.format!r}")
        if self.compression not in ("none", "gzip", "zstd"):
            raise ValueError(f"unknown compression {self.compression!r}")


@dataclass(frozen=True)
class Exact:
    field: str | None = None
    normalize: bool = False


@dataclass(frozen=True)
class Fuzzy:
    threshold: float = 0.85
    field: str = "text"


@dataclass(frozen=True)
class Filters:
    language: LanguageConfig = field(default_factory=LanguageConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)


@dataclass(frozen=True)
class PipelineConfig:
    input: Io
    output: Io
    exact: Exact | None = None
    fuzzy: Fuzzy | None = None
    filters: Filters | None = None

    @classmethod
    def default_english(cls) -> PipelineConfig:
        return cls(Io("input.jsonl"), Io("output.jsonl"), Exact("text", True), Fuzzy(0.85), Filters())

    @classmethod
    def default_multilingual(cls) -> PipelineConfig:
        return cls(Io("input.jsonl"), Io("output.jsonl"), Exact("text", True), Fuzzy(0.8), Filters(LanguageConfig.multilingual(), QualityConfig.lenient()))


def _make(kind: type, raw: dict[str, Any]):
    known = {f.name for f in fields(kind)}
    if extra := set(raw) - known:
        raise ValueError(f"unknown keys for {kind.__name__}: {', '.join(sorted(extra))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def filters_from(raw: dict[str, Any]) -> Filters:
    return Filters(_make(LanguageConfig, raw.get("language", {})), _make(QualityConfig, raw.get("quality", {})))


def pipeline_from(raw: dict[str, Any]) -> PipelineConfig:
    dedup = raw.get("deduplication") or {}
    return PipelineConfig(
        _make(Io, raw["input"]),
        _make(Io, raw["output"]),
        _make(Exact, dedup["exact"]) if dedup.get("exact") is not None else None,
        _make(Fuzzy, dedup["fuzzy"]) if dedup.get("fuzzy") is not None else None,
        filters_from(raw["filters"]) if raw.get("filters") is not None else None,
    )


def parse(path: str | Path) -> dict[str, Any]:
    path = Path(path)
    text = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        return _yaml().safe_load(text)
    if path.suffix == ".toml":
        return tomllib.loads(text)
    raise ValueError(f"unsupported config file {path.name}: use .yaml, .yml or .toml")


def load_pipeline(path: str | Path) -> PipelineConfig:
    return pipeline_from(parse(path))


def load_filters(path: str | Path) -> Filters:
    return filters_from(parse(path))


def as_dict(cfg: PipelineConfig) -> dict[str, Any]:
    plain = lambda x: {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(x).items() if v is not None}
    out: dict[str, Any] = {"input": plain(cfg.input), "output": plain(cfg.output)}
    dedup = {k: plain(v) for k, v in (("exact", cfg.exact), ("fuzzy", cfg.fuzzy)) if v}
    if dedup:
        out["deduplication"] = dedup
    if cfg.filters:
        out["filters"] = {"language": plain(cfg.filters.language), "quality": plain(cfg.filters.quality)}
    return out


def to_toml(raw: dict[str, Any], prefix: str = "") -> str:
    flat = [f"{k} = {json.dumps(v)}" for k, v in raw.items() if not isinstance(v, dict)]
    lines = ([f"[{prefix}]"] if prefix and flat else []) + flat + ([""] if flat else [])
    for k, v in raw.items():
        if isinstance(v, dict):
            lines.append(to_toml(v, f"{prefix}.{k}" if prefix else k))
    return "\n".join(lines)


def save(cfg: PipelineConfig, path: str | Path) -> None:
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        path.write_text(_yaml().safe_dump(as_dict(cfg), sort_keys=False))
    elif path.suffix == ".toml":
        path.write_text(to_toml(as_dict(cfg)))
    else:
        raise ValueError(f"unsupported config file {path.name}: use .yaml, .yml or .toml")


def check_bounds(threshold: float, hashes: int, shingle: int, rows: int) -> None:
    for name, value, low, high in (("threshold", threshold, 0, 1), ("hashes", hashes, 16, 1024), ("shingle", shingle, 1, 10), ("rows", rows, 1, 32)):
        if not low <= value <= high:
            raise ValueError(f"{name} must lie in {low}..{high}")
