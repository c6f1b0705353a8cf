"""Plain text of RTF files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups that hold no text of the document, and control words that stand for characters.
SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "*"}
SPOKEN = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
PIECE = re.compile(r"\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<word>[a-z]+)(?P<number>-?\d+)? ?|\\(?P<sign>[^a-z])|(?P<brace>[{}])|(?P<text>[^\\{}\r\n]+)", re.DOTALL)


def plain(source: str) -> str:
    """The text of an RTF source: escapes become characters, silent groups and formats vanish."""
    out, quiet, stack, skip = [], False, [], 0
    for m in PIECE.finditer(source):
        if m["brace"] == "{":
            stack.append(quiet)
            continue
        if m["brace"] == "}":
            quiet = stack.pop() if stack else False
            continue
        word, said = m["word"], m["text"] or ""
        if word in SILENT or m["sign"] == "*":
            quiet = True
        elif word == "u" and m["number"]:
            said, skip = chr(int(m["number"]) % 0x10000), -1
        elif m["byte"]:
            said = bytes([int(m["byte"], 16)]).decode("cp1252", "replace")
        elif m["sign"]:
            said = {"~": " ", "{": "{", "}": "}", "\\": "\\", "\n": "\n", "_": "-"}.get(m["sign"], "")
        elif word:
            said = SPOKEN.get(word, "")
        # One stand-in character follows each Unicode escape.
        if skip > 0 and said:
            said, skip = said[1:], 0
        skip = 1 if skip < 0 else skip
        if not quiet:
            out.append(said)
    # Pairs of surrogates become their character, lone ones a replacement sign.
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").strip()


def rtf_text(content: Column) -> Column:
    """Text of binary RTF content; null for anything else."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: plain(bytes(b).decode("latin-1")) if bytes(b[:5]) == b"{\\rtf" else None, na_action="ignore")

    return run(content)
