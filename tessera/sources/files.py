"""Files as DataFrames: listing, filters, hashes, text, CSV, office containers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Directory names that are never entered.
EXCLUDED_DIRS = ("$recycle.bin", "system volume information", "$winreagent", "$sysreset", "config.msi", "recovery", "node_modules", ".pnpm-store", "pnpm-store", "npm-cache", ".npm", ".yarn", ".pnpm-debug.log", ".cache", ".git", ".svn", ".hg", ".idea", ".vscode", ".vs", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".tox", ".gradle", "target", "$baksd", "$lbak", "$recycle", "system volume information backup", "onedrivetemp", ".trash", ".trash-$(whoami)", ".spotlight-v100", ".documentrevisions-v100", ".fseventsd")
MAX_ROWS, MAX_COLS = 200, 26


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content under root; the glob is applied while listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """The lower-case last extension with its dot; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def excluded(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a directory on the path is excluded."""
    dirs = F.split(F.lower(path), r"[/\\]")
    return F.arrays_overlap(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*[F.lit(d) for d in (*EXCLUDED_DIRS, *[m.lower() for m in more])]))


def included(path: Column, whitelist: list[str]) -> Column:
    """No temporary file (~...), and an extension of the whitelist (dots optional)."""
    wanted = [w.lower() if w.startswith(".") else f".{w.lower()}" for w in whitelist]
    return ~basename(path).startswith("~") & (extension(path) != "") & extension(path).isin(wanted)


def skip_reason(size: Column, folder_cap: int | None, global_cap: int) -> Column:
    cap = global_cap if folder_cap is None else min(folder_cap, global_cap)
    return F.when(size > cap, F.concat(F.lit("skipped: "), size.cast("string"), F.lit(f" bytes over {cap}")))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root of it first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def watch_targets(files: DataFrame, path: str = "path") -> DataFrame:
    """dir: every directory with a file, and those above."""
    return files.select(F.explode(ancestors(F.col(path))).alias("dir")).where("dir <> ''").distinct()


def sha1(content: Column) -> Column:
    return F.sha1(content)


def container(content: Column) -> Column:
    """ole2, zip or other by the leading bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "D0CF11E0A1B11AE1", "ole2").when(head.startswith("504B0304"), "zip").otherwise("other")


def is_fake(path: Column, content: Column) -> Column:
    """A container that its extension does not go with."""
    kind, ext = container(content), extension(path)
    return (ext.isin(".docx", ".xlsx", ".pptx") & (kind != "zip")) | (ext.isin(".doc", ".xls", ".ppt") & (kind != "ole2"))


def read_text(files: DataFrame) -> DataFrame:
    """path, text, garbled: UTF-8, else GB18030, else UTF-8 with replacements; lines normalised."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(_decode)

    text = T.normalize_lines(decoded("content"))
    return files.select("path", text.alias("text")).withColumn("garbled", T.is_garbled(F.col("text")))


def _decode(raw: bytes | None) -> str:
    for encoding in ("utf-8", "gb18030"):
        try:
            return bytes(raw or b"").decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("utf-8", "replace")


def markdown_table(rows: list[list[str]], max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> str:
    """Header, rule, rows; ragged rows are padded; what is over the row cap is told in a last row."""
    if not rows:
        return ""
    width = min(max(map(len, rows)), max_cols)
    cells = [[re.sub(r"\r?\n", " ", c.replace("|", "\\|")).strip() for c in [*r[:width], *[""] * (width - len(r))]] for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    out = [line(cells[0]), line(["---"] * width), *map(line, cells[1 : 1 + max_rows])]
    if len(cells) > 1 + max_rows:
        out.append(f"| _… {len(cells) - 1 - max_rows} more rows omitted (capped at {max_rows} per file to bound embedding cost) …_ |")
    return "\n".join(out).rstrip() + "\n"


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    import csv

    return [r or [""] for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=delimiter)]


def sniff_delimiter(text: str) -> str:
    """Of tab, comma and semicolon the commonest in the first line; the earlier in this order if equal."""
    first = text.split("\n", 1)[0]
    return max("\t,;", key=lambda d: (first.count(d), -"\t,;".index(d)))


def csv_markdown(raw: bytes) -> str:
    """A table of delimited text in any of the known encodings and delimiters."""
    text = _decode(raw)
    return markdown_table(parse_csv(text, sniff_delimiter(text.removeprefix("\ufeff"))))


def _sheet_rows(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet of a workbook."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            path = targets[sheet.get(rel)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{main}row"):
                cells: list[str] = []
                for c in row.iter(f"{main}c"):
                    column = 0
                    for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                        column = column * 26 + ord(ch) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = c.find(f"{main}v")
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if value is None else value.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" else text)
                rows.append(cells)
            out.append((sheet.get("name"), rows))
        return out


def xlsx_markdown(raw: bytes, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> str:
    parts = []
    for name, rows in _sheet_rows(raw):
        if len(rows) > max_rows or max(map(len, rows), default=0) > max_cols:
            parts.append(f"## {name}\n\n_sheet skipped: {len(rows)} rows_\n")
        elif rows:
            parts.append(f"## {name}\n\n{markdown_table(rows, max_rows, max_cols)}")
    return "\n".join(parts)


def pptx_markdown(raw: bytes) -> str:
    """A heading and bullets for each slide, in the slides' numeric order."""
    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for number, name in slides:
            lines = [s for p in ElementTree.fromstring(z.read(name)).iter(f"{a}p") if (s := "".join(t.text or "" for t in p.iter(f"{a}t")).strip())]
            out.append("\n".join([f"## {lines[0] if lines else f'Slide {number}'}", "", *[f"- {x}" for x in lines[1:]]]).rstrip() + "\n")
        return "\n".join(out)


def docx_markdown(raw: bytes) -> str:
    """Paragraphs, headings by their style's level, list items by their depth, tables (each cell's paragraphs on one line)."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text_of(node) -> str:
        return "".join({f"{w}t": x.text or "", f"{w}tab": "\t", f"{w}br": " "}.get(x.tag, "") for x in node.iter()).strip()

    def paragraph(p) -> tuple[str, bool]:
        """(markdown, whether it is a list item)"""
        text, about = text_of(p), p.find(f"{w}pPr")
        if not text or about is None:
            return text, False
        style, number = about.find(f"{w}pStyle"), about.find(f"{w}numPr")
        if style is not None and (level := re.match(r"(?i)heading\s*(\d)", style.get(f"{w}val", ""))):
            return f"{'#' * int(level[1])} {text}", False
        if number is None:
            return text, False
        depth = number.find(f"{w}ilvl")
        return "  " * int(depth.get(f"{w}val", "0") if depth is not None else 0) + f"- {text}", True

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    blocks: list[tuple[str, bool]] = []
    for node in body if body is not None else ():
        if node.tag == f"{w}p" and (got := paragraph(node))[0]:
            blocks.append(got)
        elif node.tag == f"{w}tbl":
            rows = [[" ".join(filter(None, (text_of(p) for p in cell.iter(f"{w}p")))) for cell in row.findall(f"{w}tc")] for row in node.findall(f"{w}tr")]
            if any(map(any, rows)):
                blocks.append((markdown_table(rows).rstrip(), False))
    out = ""
    for i, (text, item) in enumerate(blocks):
        out += ("" if not i else "\n" if item and blocks[i - 1][1] else "\n\n") + text
    return out + "\n" if out else ""


def lines_of_runs(runs: DataFrame) -> DataFrame:
    """page, line, text: runs (page, x, y, str) on one height, to a tenth, from top to bottom, joined by x."""
    height = F.round("y", 1)
    rows = runs.groupBy("page", height.alias("height")).agg(F.array_sort(F.collect_list(F.struct("x", "str"))).alias("r"))
    texts = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("down"), F.array_join(F.transform("r", lambda x: x["str"]), " ").alias("text")))).alias("t"))
    return texts.select("page", F.posexplode("t").alias("line", "s")).select("page", "line", "s.text")


_READERS = {
    ".csv": lambda raw: csv_markdown(raw), ".xlsx": xlsx_markdown, ".pptx": pptx_markdown, ".docx": docx_markdown,
    ".txt": lambda raw: _decode(raw), ".md": lambda raw: _decode(raw),
}


def register_reader(ext: str, reader) -> None:
    """reader(bytes) -> str for files of an extension; takes the place of one that is there."""
    _READERS[ext.lower()] = reader


def convert(files: DataFrame, most: int = 50_000_000) -> DataFrame:
    """path, text, error of files (path, content) by their extension; texts end at `most` characters."""
    readers = dict(_READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b["path"], b["content"]):
                ext = re.search(r"[^/\\](\.[^./\\]*)$", path)
                reader = readers.get(ext[1].lower()) if ext else None
                try:
                    texts.append(reader(bytes(content))[:most] if reader else None)
                    errors.append(None if reader else "no reader")
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": b["path"], "text": texts, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string").withColumn("text", T.normalize_lines(F.col("text")))
