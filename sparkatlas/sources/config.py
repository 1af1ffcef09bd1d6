"""Settings of codebases: defaults, checks, values from the environment; expected answers of a benchmark."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The defaults of settings that are missing or 0.
DEFAULTS = {
    "indexing": {"chunk_max_lines": 200, "chunk_overlap_lines": 20, "batch_size": 128, "concurrent_requests": 10, "concurrent_files": 4},
    "embedding": {"dimensions": 1024}, "metadata_store": {"max_connections": 20, "port": 5432}, "summaries": {"top_classes": 1000}, "metrics": {"port": 9091}, "vector_store": {"collection_prefix": "codebase"},
}


@dataclass
class Config:
    codebase: dict = field(default_factory=dict)
    sections: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Config:
        """From nested values; what is missing or 0 gets its default."""
        own = {k: dict(v) for k, v in values.items() if isinstance(v, dict)}
        for name, defaults in DEFAULTS.items():
            section = own.setdefault(name, {})
            section.update({k: v for k, v in defaults.items() if not section.get(k)})
        return cls(own.pop("codebase", {}), own)

    def check(self, server: bool = False) -> None:
        """For an indexer a codebase needs a name and a path; for a server the stores need hosts."""
        needed = [("vector_store", "host"), ("metadata_store", "host")] if server else []
        missing = [f"{a}.{b}" for a, b in needed if not self.sections.get(a, {}).get(b)]
        missing += [] if server else [f"codebase.{k}" for k in ("name", "path") if not self.codebase.get(k)]
        if missing:
            raise ValueError("missing settings: " + ", ".join(missing))

    def secret(self, section: str) -> str:
        """The value of the environment variable that a section's api_key_env names; '' if there is none."""
        return os.environ.get(self.sections.get(section, {}).get("api_key_env", ""), "")


def parsed(text: str) -> dict:
    """JSON, or YAML where its module is there."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def load(path: str, server: bool = False) -> Config:
    with open(path) as f:
        config = Config.of(parsed(f.read()))
    config.check(server)
    return config


def load_all(folder: str) -> list[Config]:
    """The .yaml and .yml files of a folder, sorted; a codebase's name may occur once."""
    names = sorted(n for n in os.listdir(folder) if n.endswith((".yaml", ".yml")))
    out = [load(os.path.join(folder, n)) for n in names]
    seen = [c.codebase["name"] for c in out]
    if twice := {n for n in seen if seen.count(n) > 1}:
        raise ValueError("codebases named twice: " + ", ".join(sorted(twice)))
    return out


def known_answers(spark: SparkSession, path: str) -> DataFrame:
    """query, expected_symbols and expected_files of a JSON array."""
    return spark.read.json(path, multiLine=True, schema="query string, expected_symbols array<string>, expected_files array<string>")
