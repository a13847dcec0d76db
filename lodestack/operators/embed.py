"""Embeddings of function descriptions by pluggable providers.

A provider lives in the partition's Python worker. A chain tries its members in
order for every text and stays with the first that works; each row says which
provider made its vector and how long that is, so vectors of different models
are never taken for comparable. A text that fails keeps its row, with an error.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from lodestack.functions.scalar import embedding_text, language_of, row_id

TIMEOUT = 30


class Provider(Protocol):
    name: str

    def embed(self, text: str) -> list[float]: ...


class HashingProvider:
    """Deterministic and offline: signed hashing of words, unit length."""

    name = "hashing"

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).tolist()


def _post(url: str, body: dict, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.load(answer)


class LocalHttpProvider:
    """POST /api/embeddings {model, prompt} of a local server."""

    def __init__(self, base_url: str = "http://localhost:11434", model: str = "nomic-embed-text"):
        self.base_url, self.model, self.name = base_url.rstrip("/"), model, f"local:{model}"

    def embed(self, text: str) -> list[float]:
        if vector := _post(f"{self.base_url}/api/embeddings", {"model": self.model, "prompt": text}).get("embedding"):
            return vector
        raise ValueError("empty embedding")

    def is_available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base_url}/api/tags", timeout=2) as answer:
                return answer.status == 200
        except OSError:
            return False


class CloudHttpProvider:
    """POST {model, input} with a bearer key; the first data row counts."""

    def __init__(self, api_key: str, model: str = "text-embedding-3-small", url: str = "https://api.openai.com/v1/embeddings"):
        self.api_key, self.model, self.url, self.name = api_key, model, url, f"cloud:{model}"

    def embed(self, text: str) -> list[float]:
        data = _post(self.url, {"model": self.model, "input": text}, {"Authorization": f"Bearer {self.api_key}"}).get("data") or []
        if not data:
            raise ValueError("no data")
        return data[0]["embedding"]


class Chain:
    """The first provider that works; after a failure the next takes over for good."""

    def __init__(self, providers: list[Provider]):
        self.providers, self.at = providers, 0

    @property
    def name(self) -> str:
        return self.providers[self.at].name if self.at < len(self.providers) else "none"

    def embed(self, text: str) -> list[float]:
        errors = []
        while self.at < len(self.providers):
            try:
                return self.providers[self.at].embed(text)
            except (OSError, ValueError, KeyError) as e:
                errors.append(f"{self.name}: {e}")
                if self.at + 1 == len(self.providers):
                    break
                self.at += 1
        raise ValueError("; ".join(errors) or "no provider")


def first_working(providers: list[Provider], probe: str = "probe") -> Provider:
    """The first provider that makes a vector, asked once here: all tasks use the same one, whatever is partitioned or tried again how."""
    errors = []
    for p in providers:
        try:
            if len(p.embed(probe)):
                return p
            errors.append(f"{p.name}: empty embedding")
        except (OSError, ValueError, KeyError) as e:
            errors.append(f"{p.name}: {e}")
    raise ValueError("; ".join(errors) or "no provider")


def describe(functions: DataFrame) -> DataFrame:
    """functions -> id, place, language and `code`, the text that is embedded."""
    language = language_of(F.col("file_path"))
    text = embedding_text(language, F.col("name"), F.col("parameters"), F.col("return_type"), F.col("comments"), F.col("complexity"), F.col("loc"))
    return functions.select(row_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"), "repo_id", "file_path", F.col("name").alias("func_name"), "start_line", "end_line", text.alias("code"), language.alias("language"))


def embed(described: DataFrame, provider: Provider) -> DataFrame:
    """described plus embedding, provider, dim and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["code"]:
                try:
                    v = provider.embed(text)
                    rows.append((np.asarray(v, np.float32), provider.name, len(v), None))
                except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
                    rows.append((None, provider.name, 0, str(e)))
            yield pdf.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("embedding", "provider", "dim", "error"))})

    added = StructType().add("embedding", ArrayType(FloatType())).add("provider", "string").add("dim", "integer").add("error", "string")
    return described.mapInPandas(run, StructType([*described.schema.fields, *added.fields]))


def refreshed(described: DataFrame, index: DataFrame, provider: Provider) -> DataFrame:
    """The index brought up to date: kept where id and text are unchanged, embedded where new, dropped where gone."""
    kept = index.where("error is null").join(described.select("id", "code"), ["id", "code"], "left_semi")
    new = described.join(kept.select("id", "code"), ["id", "code"], "left_anti").select(*described.columns)
    return kept.unionByName(embed(new, provider))
