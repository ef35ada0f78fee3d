"""Embedders, text generators and tokenizers: interfaces, and defaults that need no model.

A real model is anything with the same methods. It is loaded once per worker, from a factory that
is called there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class TextGenerator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...
    def truncate(self, text: str, tokens: int) -> str: ...


class HashEmbedder:
    """Counts of words in buckets by a hash of the word, divided by their length."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).astype(np.float32)


class NormalisedEmbedder:
    """Another embedder's vectors, divided by their length; those of length 0 stay."""

    def __init__(self, inner: Callable[[], Embedder]) -> None:
        self.inner = inner()

    def embed(self, texts: list[str]) -> np.ndarray:
        x = np.asarray(self.inner.embed(texts), np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=x, where=n > 0).astype(np.float32)


class HttpEmbedder:
    """Vectors from a service that takes ``{"model", "input"}`` and answers with ``{"data": [{"index", "embedding"}]}``.

    Blank texts are sent as a single blank, since such services refuse them. ``send`` (url, headers, body) -> answer can be replaced, for tests.
    """

    def __init__(self, url: str, model: str, key: str = "", batch: int = 64, timeout: float = 60.0, send: Callable[[str, dict, dict], dict] | None = None) -> None:
        self.url, self.model, self.key, self.batch, self.timeout = url, model, key, batch, timeout
        self.send = send or self._post

    def _post(self, url: str, headers: dict, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def embed(self, texts: list[str]) -> np.ndarray:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            body = {"model": self.model, "input": [t if t.strip() else " " for t in texts[i : i + self.batch]]}
            data = self.send(self.url, {"Authorization": f"Bearer {self.key}"} if self.key else {}, body)["data"]
            out += [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        return np.asarray(out, np.float32)


def _task_text(prompt: str) -> str:
    """What follows the instruction, which ends with the first blank line."""
    return prompt.split("\n\n", 1)[-1]


class ExtractiveGenerator:
    """Answers with a JSON list of the longest sentences of the prompt's text, in their order."""

    def __init__(self, items: int = 10) -> None:
        self.items = items

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            parts = [x.strip() for x in re.split(r"(?<=[.!?。！？])\s+|\n+", _task_text(prompt or "")) if len(x.strip()) > 10]
            keep = sorted(sorted(range(len(parts)), key=lambda i: (-len(parts[i]), i))[: self.items])
            out.append(json.dumps([parts[i] for i in keep], ensure_ascii=False))
        return out


class FactExtractor:
    """Answers with a JSON list of facts: a line with a number or a name in it, its speaker, and the numbers and names."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            facts = []
            for line in _task_text(prompt or "").splitlines():
                speaker, found, said = line.partition(": ")
                said = said if found else line
                values = re.findall(r"(?<=\s)[^\W\d_a-zß-öø-ÿ][\w-]+|\d[\d.,:]*\d|\d", said)
                if values:
                    facts.append({"time": "", "subject": speaker if found else "", "fact": said.strip(), "entities_or_values": ", ".join(dict.fromkeys(values))})
            out.append(json.dumps(facts, ensure_ascii=False))
        return out


class CharTokenizer:
    """Three characters a token."""

    def count(self, text: str) -> int:
        return len(text) // 3

    def truncate(self, text: str, tokens: int) -> str:
        return text if self.count(text) <= tokens else text[: 3 * tokens] + "..."


class FileTokenizer:
    """A tokenizer from a vocabulary file: ``.json`` for ``tokenizers``, ``.tiktoken`` (ranks, with the pattern that cuts words), ``.model`` for ``sentencepiece``."""

    #: Fixed value: the pattern of public byte-pair vocabularies.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        if path.endswith(".json"):
            from tokenizers import Tokenizer as Vocabulary

            v = Vocabulary.from_file(path)
            v.encode_special_tokens = True
            self._encode, self._decode = lambda t: v.encode(t, add_special_tokens=False).ids, v.decode
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, lines)}
            e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._encode, self._decode = e.encode_ordinary, e.decode
        else:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode, self._decode = m.encode, m.decode

    def count(self, text: str) -> int:
        return len(self._encode(text)) if text else 0

    def truncate(self, text: str, tokens: int) -> str:
        ids = self._encode(text)
        return text if len(ids) <= tokens else self._decode(ids[:tokens]) + "..."


def tokenizer(path: str | None = None) -> Callable[[], Tokenizer]:
    """The tokenizer of a vocabulary file if it can be read here, else three characters a token."""

    def make() -> Tokenizer:
        try:
            return FileTokenizer(path) if path and os.path.exists(path) else CharTokenizer()
        except ImportError:
            return CharTokenizer()

    return make


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "normalised": NormalisedEmbedder, "http": HttpEmbedder}
GENERATORS: dict[str, Callable[..., TextGenerator]] = {"extractive": ExtractiveGenerator, "facts": FactExtractor}
TOKENIZERS: dict[str, Callable[..., Tokenizer]] = {"chars": CharTokenizer, "file": FileTokenizer}


def embed(text: str | Column, factory: Callable[[], Embedder] = HashEmbedder, batch: int = 32) -> Column:
    """Vectors of a text column; null for null. The model is made once per worker and fed ``batch`` texts at a time."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            texts = s.tolist()
            out: list = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                vectors = model.embed([t or "" for t in part])
                out += [None if t is None else v.tolist() for t, v in zip(part, vectors, strict=True)]
            yield pd.Series(out, index=s.index)

    return run(F.col(text) if isinstance(text, str) else text)


def generate(prompt: str | Column, factory: Callable[[], TextGenerator] = ExtractiveGenerator) -> Column:
    """Answers to a column of prompts; null for null."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            answers = model.generate([t or "" for t in s.tolist()])
            yield pd.Series([None if t is None else a for t, a in zip(s.tolist(), answers, strict=True)], index=s.index)

    return run(F.col(prompt) if isinstance(prompt, str) else prompt)
