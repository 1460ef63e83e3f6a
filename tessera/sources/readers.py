"""Readers of file formats, chosen in the task for each file: by priority, claim and probe, the next one where one fails.

A reader is a class named by its import path ("package.module:Class"), so it only has to be
importable where tasks run; instances are made once a task.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import files

#: Characters of a converted file; what is over is told in a last line.
MOST_CHARS = 50_000_000
#: Bytes that a probe sees.
HEAD = 4096


class Reader:
    """Reads files of some extensions (with dots; `*` for all) that its probe accepts.  Of two that claim a file the higher priority goes first, then the earlier name."""

    extensions: ClassVar[tuple[str, ...]] = ()
    priority: ClassVar[int] = 0

    def probe(self, path: str, head: bytes) -> bool:
        """Whether this can be a file of the format; cheap, by its first bytes."""
        return True

    def read(self, path: str, content: bytes) -> str:
        raise NotImplementedError


class Text(Reader):
    """UTF-8 or GB18030; a text that is neither is refused."""

    extensions = (".txt", ".md")

    def read(self, path: str, content: bytes) -> str:
        for encoding in ("utf-8-sig", "gb18030"):
            try:
                return content.decode(encoding)
            except UnicodeDecodeError:
                continue
        raise ValueError("neither UTF-8 nor GB18030")


class Delimited(Reader):
    """Comma, tab or semicolon separated values as a table, up to `rows` rows."""

    extensions = (".csv",)
    rows: ClassVar[int] = 50_000

    def read(self, path: str, content: bytes) -> str:
        text = Text().read(path, content)
        return files.markdown_table(files.parse_csv(text, files.sniff_delimiter(text)), self.rows, 10_000)


class _Zipped(Reader):
    def probe(self, path: str, head: bytes) -> bool:
        return head.startswith(b"PK\x03\x04")


class Workbook(_Zipped):
    extensions = (".xlsx",)

    def read(self, path: str, content: bytes) -> str:
        return files.xlsx_markdown(content)


class Slides(_Zipped):
    extensions = (".pptx",)

    def read(self, path: str, content: bytes) -> str:
        return files.pptx_markdown(content)


class Document(_Zipped):
    extensions = (".docx",)

    def read(self, path: str, content: bytes) -> str:
        return files.docx_markdown(content)


BUILT_IN = tuple(f"{__name__}:{c.__name__}" for c in (Text, Delimited, Workbook, Slides, Document))


def loaded(names: tuple[str, ...]) -> list[tuple[str, Reader]]:
    """(name, reader) by falling priority, then name."""
    out = []
    for name in names:
        module, _, cls = name.partition(":")
        out.append((name, getattr(importlib.import_module(module), cls)()))
    return sorted(out, key=lambda x: (-x[1].priority, x[0]))


def _extension(path: str) -> str:
    found = re.search(r"[^/\\](\.[^./\\]*)$", path)
    return found[1].lower() if found else ""


def read_one(path: str, content: bytes | None, readers: list[tuple[str, Reader]], most: int = MOST_CHARS) -> tuple[str | None, str | None, list[str]]:
    """(text, name of the reader, errors of those before it): by the first reader that claims the file, accepts its head and does not fail."""
    ext, raw, errors = _extension(path), bytes(content or b""), []
    for name, reader in readers:
        if ext not in reader.extensions and "*" not in reader.extensions:
            continue
        try:
            if not reader.probe(path, raw[:HEAD]):
                continue
            text = reader.read(path, raw)
        except Exception as e:  # noqa: BLE001 - whatever a format's parser raises; the next reader is asked
            errors.append(f"{name}: {type(e).__name__}: {e}")
            continue
        if len(text) > most:
            text = f"{text[:most]}\n\n*(truncated: {len(text)} characters, {most} allowed)*\n"
        return text, name, errors
    return None, None, errors or [f"no reader for {ext or 'files without extension'}"]


def read_files(found: DataFrame, readers: tuple[str, ...] = (), most: int = MOST_CHARS) -> DataFrame:
    """path, text (lines normalised), reader, errors of files (path, content); the given readers stand beside the built-in ones.

    Files of one batch are read one after the other and let go, so a task holds a batch of
    contents (bounded by spark.sql.execution.arrow.maxBytesPerBatch) and one text.
    """
    names = (*readers, *BUILT_IN)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = loaded(names)
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, *read_one(path, content, ready, most))], columns=["path", "text", "reader", "errors"])

    got = found.select("path", "content").mapInPandas(run, "path string, text string, reader string, errors array<string>")
    return got.withColumn("text", T.normalize_lines(F.col("text")))
