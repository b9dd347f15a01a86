"""Settings of models and of deployments: typed, checked, resolved in layers."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.operators.catalog import ALIASES, FRONTENDS

MAGNITUDES = ["none", "pwl", "pcen", "db"]


@dataclass
class ModelConfig:
    """What a model was trained with. Unknown keys of files are dropped, missing ones have these values."""

    sample_rate: int = 24_000
    num_mels: int = 64
    spec_width: int = 256
    fft_length: int = 512
    chunk_duration: float = 3.0
    hop_length: int = 281
    audio_frontend: str = "hybrid"
    mag_scale: str = "pwl"
    n_mfcc: int = 20
    embeddings_size: int = 256
    alpha: float = 1.0
    depth_multiplier: int = 1
    use_se: bool = True
    se_reduction: int = 8
    use_inverted_residual: bool = True
    expansion_factor: int = 2
    use_attention_pooling: bool = False
    dropout_rate: float = 0.5
    frontend_trainable: bool = False
    num_classes: int = 0
    class_names: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.audio_frontend = ALIASES.get(self.audio_frontend, self.audio_frontend)
        checks = {
            "sample_rate": self.sample_rate > 0, "chunk_duration": self.chunk_duration > 0, "num_mels": self.num_mels > 0, "spec_width": self.spec_width > 0, "fft_length": self.fft_length > 0,
            "audio_frontend": self.audio_frontend in FRONTENDS, "mag_scale": self.mag_scale in MAGNITUDES, "alpha": self.alpha > 0, "depth_multiplier": self.depth_multiplier >= 1,
            "dropout_rate": 0 <= self.dropout_rate < 1, "num_classes": self.num_classes >= 0, "class_names": not self.class_names or len(self.class_names) == self.num_classes,
        }
        if wrong := [k for k, good in checks.items() if not good]:
            raise ValueError(f"not valid: {', '.join(wrong)}")

    @classmethod
    def from_dict(cls, given: dict) -> ModelConfig:
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    @classmethod
    def from_json(cls, text: str) -> ModelConfig:
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


# The fields' names and defaults above are the JSON interface.
SQL_TYPES = {"int": "int", "float": "double", "str": "string", "bool": "boolean", "list[str]": "array<string>"}
SCHEMA = ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in fields(ModelConfig))


def parsed(text: Column) -> Column:
    """A structure from JSON text, with the defaults for what is missing and aliases resolved; text that is not JSON gives the defaults."""
    given, standard = F.from_json(text, SCHEMA), asdict(ModelConfig())
    value = lambda k, v: F.coalesce(given[k], F.array().cast("array<string>") if isinstance(v, list) else F.lit(v))
    name = value("audio_frontend", standard["audio_frontend"])
    for alias, own in ALIASES.items():
        name = F.when(given["audio_frontend"] == alias, F.lit(own)).otherwise(name)
    return F.struct(*((name if k == "audio_frontend" else value(k, v)).alias(k) for k, v in standard.items()))


@dataclass(frozen=True)
class DeployConfig:
    """Settings of a device run."""

    model_path: str = ""
    port: str = "/dev/ttyACM0"
    baud: int = 115_200
    timeout: float = 120.0
    top_k: int = 5
    score_threshold: float = 0.01


def read_settings(path: str) -> dict:
    """A TOML or JSON file, whichever it is; without one of that name, the one with the other ending; {} without either."""
    stem, ending = os.path.splitext(path)
    for name in (path, stem + {".json": ".toml", ".toml": ".json"}.get(ending, ending)):
        if os.path.isfile(name):
            with open(name, "rb") as f:
                return parsed_settings(f.read().decode(), name.endswith(".json"))
    return {}


def parsed_settings(text: str, is_json: bool = False) -> dict:
    """TOML or JSON, the other where the one does not fit; the tables `deploy` and `build` are made one."""
    try:
        found = json.loads(text) if is_json else tomllib.loads(text)
    except (tomllib.TOMLDecodeError, json.JSONDecodeError):
        found = tomllib.loads(text) if is_json else json.loads(text)
    flat = {k: v for k, v in found.items() if not isinstance(v, dict)}
    return flat | found.get("deploy", {}) | found.get("build", {})


def layered_columns(*layers: dict[str, Column]) -> Column:
    """A structure of settings from layers of text columns, the first that has a value for each: null and empty ones do not count."""
    def value(f) -> Column:
        found = [F.when(layer[f.name] != "", layer[f.name]) for layer in layers if f.name in layer]
        return F.coalesce(*found, F.lit(str(f.default))).cast(SQL_TYPES[f.type]).alias(f.name)

    return F.struct(*map(value, fields(DeployConfig)))


def resolve(given: dict | None = None, path: str | None = None, prefix: str = "CORVANE_", environment: dict | None = None) -> DeployConfig:
    """Given values first, then the environment, then a file, then the defaults; empty values do not count."""
    return layered(given or {}, dict(os.environ) if environment is None else environment, read_settings(path) if path else {}, prefix)


def layered(given: dict, environment: dict, file: dict, prefix: str = "CORVANE_") -> DeployConfig:
    layers = [given, {f.name: environment.get(prefix + f.name.upper()) for f in fields(DeployConfig)}, file]
    out = {}
    for f in fields(DeployConfig):
        for layer in layers:
            if layer.get(f.name) not in (None, ""):
                out[f.name] = type(f.default)(layer[f.name])
                break
    return DeployConfig(**out)
