"""Results as JSON or text, to a folder of any size or to one file for the small result of a single document."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put_json(data: object, path: str | None = None) -> None:
    """One JSON document, indented, to a file (folders are made) or to standard output."""
    put_text(json.dumps(data, ensure_ascii=False, indent=2, default=str), path)


def put_text(text: str, path: str | None = None) -> None:
    """A text to a file as it is, or to standard output with a line end."""
    if path is None:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
