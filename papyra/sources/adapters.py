"""What needs a PDF library, a layout model or a service on the network, behind protocols.

Spark code meets only these protocols. Each has a stand-in without such a need, so that plans can be
built and tested; a real one is given to the same functions. An adapter is made once for each task.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLYPHS = "doc string, page int, container int, seq long, kind string, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, m0 double, m3 double, page_width double, page_height double"
BOXES = "doc string, page int, i int, x0 double, y0 double, x1 double, y1 double, conf double, cls string, width int, height int"


class Translator(Protocol):
    def translate(self, text: str) -> str: ...


class DocumentReader(Protocol):
    def glyphs(self, doc: str, content: bytes, pages: list[int] | None) -> Iterator[tuple]: ...


class LayoutModel(Protocol):
    stride: int

    def predict(self, doc: str, page: int) -> Iterator[tuple]: ...


@dataclass
class Service:
    """A translation service: the longest text it takes at once, what else names a cached reply, quirks."""

    name: str
    limit: int | None = None
    key_extras: tuple[str, ...] = ()
    codes: dict[str, str] = field(default_factory=dict)

    def params(self, source: str, target: str, **extra: object) -> dict:
        """What distinguishes this service's replies; a custom prompt is always part of it."""
        return {"source": self.codes.get(source, source), "target": self.codes.get(target, target), **{k: extra[k] for k in (*self.key_extras, "prompt") if extra.get(k) is not None}}


_CHAT = ("model", "temperature", "stop", "max_tokens", "think")
#: The services by name (fixed values).
SERVICES = {
    s.name: s
    for s in (
        Service("google", 5000, (), {"zh": "zh-CN"}), Service("bing", 1000, (), {"zh": "zh-Hans"}), Service("deepl", None, (), {"zh": "zh-Hans"}), Service("deeplx", None, (), {"zh": "zh-Hans"}),
        Service("ollama", None, ("model", "temperature"), {"zh": "zh-Hans"}), Service("xinference", None, ("model", "temperature")), Service("openai", None, _CHAT), Service("azure-openai", None, ("model", "temperature")),
        Service("modelscope", None, _CHAT), Service("zhipu", None, _CHAT), Service("silicon", None, _CHAT), Service("302ai", None, _CHAT), Service("gemini", None, _CHAT), Service("azure", None, (), {"zh": "zh-Hans"}),
        Service("tencent", 5000), Service("anythingllm"), Service("dify"), Service("argos", None, (), {"zh": "zh"}), Service("grok", None, _CHAT), Service("groq", None, _CHAT), Service("deepseek", None, (*_CHAT, "thinking", "effort")),
        Service("minimax", None, _CHAT), Service("openailiked", None, _CHAT), Service("qwen-mt", None, _CHAT),
    )
}


def engine_code(service: Column, language: Column) -> Column:
    """A language's code in a service's own writing; most write it as it is."""
    pairs = [F.lit(x) for s in SERVICES.values() for k, v in s.codes.items() for x in (f"{s.name}:{k}", v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(service, F.lit(":"), language)), language)


class Registry:
    """Named kernels; safe to fill from several threads."""

    def __init__(self) -> None:
        self._lock, self._made = threading.Lock(), {}

    def register(self, name: str, make: Callable[[], object]) -> None:
        with self._lock:
            self._made[name] = make

    def get(self, name: str) -> object:
        with self._lock:
            if name not in self._made:
                raise KeyError(f"unknown kernel {name!r}; known: {', '.join(sorted(self._made))}")
            return self._made[name]()


@dataclass
class EchoTranslator:
    """Gives a text back, marked with the target language; for tests and for collecting paragraphs."""

    target: str = ""

    def translate(self, text: str) -> str:
        return f"{self.target}:{text}" if self.target else text


@dataclass
class TableReader:
    """Reads pages that are JSON lists of words instead of PDF: [[page, x0, y0, size, font, text], ...]."""

    width: float = 600.0
    height: float = 800.0

    def glyphs(self, doc: str, content: bytes, pages: list[int] | None) -> Iterator[tuple]:
        for seq, (page, x0, y0, size, font, text) in enumerate(json.loads(content or b"[]")):
            if pages is None or page in pages:
                yield doc, page, 0, seq, "glyph", text, x0, y0, x0 + size * 0.5, y0 + size, size, font, 1.0, 1.0, self.width, self.height


@dataclass
class WholePageModel:
    """One text region over every page."""

    stride: int = 32
    width: int = 600
    height: int = 800

    def predict(self, doc: str, page: int) -> Iterator[tuple]:
        yield doc, page, 0, 0.0, 0.0, float(self.width), float(self.height), 0.99, "plain text", self.width, self.height


def read_glyphs(files: DataFrame, make: Callable[[], DocumentReader], pages: list[int] | None = None) -> DataFrame:
    """Glyphs and lines of files (path, content); only the wanted pages are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(reader.glyphs(path, bytes(content), pages)), columns=[c.split()[0] for c in GLYPHS.split(", ")])

    return files.select("path", "content").mapInPandas(run, GLYPHS)


def detect_regions(pages: DataFrame, make: Callable[[], LayoutModel]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield pd.DataFrame([b for d, p in zip(batch["doc"], batch["page"], strict=True) for b in model.predict(d, p)], columns=[c.split()[0] for c in BOXES.split(", ")])

    return pages.select("doc", "page").mapInPandas(run, BOXES)


def translate_texts(texts: DataFrame, make: Callable[[], Translator], tries: int = 3, column: str = "text") -> DataFrame:
    """``texts`` with ``translation``, null where the service failed ``tries`` times; the number of tries is bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()

        def one(text: str) -> str | None:
            for _ in range(tries):
                try:
                    return service.translate(text)
                except (OSError, RuntimeError, ValueError):
                    continue
            return None

        for batch in batches:
            yield batch.assign(translation=[one(t) if isinstance(t, str) else None for t in batch[column]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields), "translation string"])
    return texts.mapInPandas(run, schema)
