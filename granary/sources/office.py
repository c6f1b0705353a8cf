"""Text of Word and Excel files (Office Open XML) from their bytes."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Parts of the two formats that hold text, and the elements that end a paragraph or a row.
PARTS = re.compile(r"word/(document|footnotes|endnotes)\.xml|xl/(sharedStrings|worksheets/sheet\d+)\.xml")
ENDS = {"p", "tr", "si", "row"}


#: Largest part that is read, unpacked.
MAX_PART = 256 << 20


def paragraphs(content: bytes | None) -> list[str]:
    """Non-empty paragraphs in file order; none for what is not such a file, and of a damaged or huge part those before the damage."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        return []
    out = []
    for info in sorted((i for i in archive.infolist() if PARTS.fullmatch(i.filename)), key=lambda i: i.filename):
        held: list[str] = []
        if info.file_size > MAX_PART:
            continue
        try:
            for _, node in ElementTree.iterparse(archive.open(info)):
                tag = node.tag.rpartition("}")[2]
                if tag == "t" and node.text:
                    held.append(node.text)
                elif tag in ENDS and held:
                    out.append("".join(held))
                    held = []
                node.clear() if tag in ENDS else None
        except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            continue
    return out


def office_texts(files: DataFrame) -> DataFrame:
    """path, at, text of each paragraph of files (path, content)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, i, t) for p, c in zip(frame["path"], frame["content"], strict=True) for i, t in enumerate(paragraphs(c))]
            yield pd.DataFrame(found, columns=["path", "at", "text"])

    return files.select("path", "content").mapInPandas(rows, "path string, at int, text string")
