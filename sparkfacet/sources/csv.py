"""CSV files with an unknown delimiter and encoding, and a writer whose files can be read again."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is tried, in order.
DELIMITERS, ENCODINGS = (",", ";", "\t", "|"), ("utf-8-sig", "cp1252", "latin-1")
#: Lines looked at to find the dialect.
HEAD = 60


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    encoding: str


def sniff(lines: list[bytes], encoding: str | None = None) -> Dialect:
    """The delimiter that gives most lines the same number of fields, more fields counting for more (those within quotes are
    none); the encoding, or the first that fits."""
    encoding = encoding or next(e for e in ENCODINGS if _fits(lines, e))
    texts = [t for t in (line.decode(encoding) for line in lines) if t.strip()]
    best, delimiter = -1.0, DELIMITERS[0]
    for d in DELIMITERS:
        rows = sum(1 for _ in csv.reader(texts, delimiter=d))
        fields, often = Counter(len(fields) for fields in csv.reader(texts, delimiter=d)).most_common(1)[0] if texts else (0, 0)
        score = often / rows * (fields > 1) * (1 + min(fields, 30) / 100) if texts else 0.0
        if score > best:
            best, delimiter = score, d
    return Dialect(delimiter, encoding)


def _fits(lines: list[bytes], encoding: str) -> bool:
    try:
        return all(line.decode(encoding) is not None for line in lines)
    except UnicodeDecodeError:
        return False


def encoding_of(lines: DataFrame) -> tuple[str, bool]:
    """The first encoding that fits all lines (one column, value: the bytes as Spark reads text), and whether quoted fields go
    over several lines; found in one pass."""
    raw = F.col("value").cast("binary")
    lacking = F.decode(raw, "ISO-8859-1").rlike(r"[\x81\x8D\x8F\x90\x9D]")  # what cp1252 has no characters for
    odd = lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("utf8"), F.count_if(lacking).alias("cp1252"), F.count_if(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("open")).first()
    return ENCODINGS[0] if not odd["utf8"] else ENCODINGS[1] if not odd["cp1252"] else ENCODINGS[2], odd["open"] > 0


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by the header. All lines decide the encoding, the head (HEAD lines) the delimiter; only the
    head comes to the driver. Files are read in parts unless some quoted field goes over several lines."""
    lines = spark.read.text(path)
    head = lines.select(F.col("value").cast("binary")).limit(HEAD).toArrow().column(0).to_pylist()
    encoding, folded = encoding_of(lines)
    dialect = sniff(head, encoding)
    frame = spark.read.csv(path, sep=dialect.delimiter, header=True, multiLine=folded, encoding="UTF-8" if dialect.encoding == "utf-8-sig" else "ISO-8859-1", escape='"')
    if dialect.encoding == "cp1252":  # Spark reads no cp1252: it differs from ISO-8859-1 in control codes only
        codes, letters = _cp1252()
        frame = frame.select(*(F.translate(F.col(f"`{c}`"), codes, letters).alias(c.translate(str.maketrans(codes, letters))) for c in frame.columns))
    return frame


def _cp1252() -> tuple[str, str]:
    """The control codes that cp1252 has characters for, and these characters."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs)


def write_csv(frame: DataFrame, path: str, delimiter: str = ",") -> None:
    """A file for each partition; doubles with two decimals, arrays joined by '; '."""
    columns = []
    for f in frame.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.format_string("%.2f", c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "; ")
        columns.append(c.alias(f.name))
    frame.select(*columns).write.csv(path, sep=delimiter, header=True, escape='"')
