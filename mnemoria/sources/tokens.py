"""Access tokens from text: ``token ns1 ns2`` lines, or ``token:ns1,ns2`` arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "token string, namespaces array<string>"


def parse_argument(text: str) -> tuple[str, list[str]]:
    token, colon, names = text.partition(":")
    spaces = [n.strip() for n in names.split(",") if n.strip()]
    if not token.strip() or not colon or not spaces:
        raise ValueError(f"a token is given as token:ns1,ns2, not {text!r}")
    return token.strip(), spaces


def parse_lines(lines: list[str]) -> list[tuple[str, list[str]]]:
    """Blank lines and lines that begin with # are left out."""
    out = []
    for line in lines:
        words = line.split()
        if words and not words[0].startswith("#"):
            if len(words) < 2:
                raise ValueError(f"no namespaces in {line!r}")
            out.append((words[0], words[1:]))
    return out


def tokens(spark: SparkSession, path: str | None = None, arguments: list[str] | None = None) -> DataFrame:
    """Arguments come before a file: if any are given, the file isn't read. Token files are small configuration."""
    if arguments:
        rows = [parse_argument(a) for a in arguments]
    else:
        rows = parse_lines([r["value"] for r in spark.read.text(path).toLocalIterator()]) if path else []
    return spark.createDataFrame(rows, SCHEMA)
