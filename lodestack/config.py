"""Settings: defaults, a YAML (or JSON) file over them, the environment over that."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

DEFAULT_PATH = ".lodestack/config.yaml"


@dataclass
class Llm:
    provider: str = "openai"
    api_key: str = ""
    model: str = "gpt-4"
    base_url: str = ""


@dataclass
class Embeddings:
    model: str = "jina-code-v2"
    provider: str = "local"
    api_key: str = ""


@dataclass
class Analysis:
    max_function_length: int = 50
    complexity_threshold: int = 10
    similarity_threshold: float = 0.85


@dataclass
class Config:
    llm: Llm = field(default_factory=Llm)
    embeddings: Embeddings = field(default_factory=Embeddings)
    analysis: Analysis = field(default_factory=Analysis)

    def validate(self) -> None:
        if not self.llm.provider:
            raise ValueError("llm.provider is required")
        if self.llm.provider != "local" and not self.llm.api_key:
            raise ValueError(f"llm.api_key is required for {self.llm.provider}")
        if not self.embeddings.model:
            raise ValueError("embeddings.model is required")
        if self.analysis.max_function_length <= 0 or self.analysis.complexity_threshold <= 0:
            raise ValueError("analysis thresholds must be positive")
        if not 0 <= self.analysis.similarity_threshold <= 1:
            raise ValueError("analysis.similarity_threshold must be between 0 and 1")

    def save(self, path: str = DEFAULT_PATH) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as f:
            for name, part in asdict(self).items():
                f.write(f"{name}:\n" + "".join(f"  {k}: {json.dumps(v)}\n" for k, v in part.items() if v != "" or k == "api_key"))


def _parsed(text: str) -> dict:
    """Two levels of `key: value`, which is all that a configuration has."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    part = None
    for n, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        key, colon, value = body.strip().partition(":")
        if not colon or (body[0].isspace() and part is None):
            raise ValueError(f"line {n}: {line!r}")
        if not body[0].isspace():
            part = out.setdefault(key, {})
        else:
            value = value.strip()
            try:
                part[key] = json.loads(value)
            except ValueError:
                part[key] = value.strip("'")
    return out


def load(path: str = "") -> Config:
    """A missing file means defaults; the environment counts either way."""
    config = Config()
    path = path or DEFAULT_PATH
    if os.path.exists(path):
        with open(path) as f:
            for name, values in _parsed(f.read()).items():
                part = getattr(config, name)
                for k, v in values.items():
                    if k in {x.name for x in fields(part)}:
                        setattr(part, k, type(getattr(part, k))(v))
    own = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}.get(config.llm.provider, "")
    config.llm.api_key = os.environ.get(own) or os.environ.get("LODESTACK_LLM_API_KEY") or config.llm.api_key
    return config
