"""CSV files: inference on a bounded sample, header detection, strict rows, compression by content."""

from __future__ import annotations

import csv as pycsv
import gzip
import io
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import File, SourceError, check_location, head, list_files

_SAMPLE_BYTES = 4 << 20
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_ ]*$")


@dataclass(frozen=True)
class CsvOptions:
    header: bool | None = None
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    sample_size: int = 10_000
    compression: str = "auto"

    def __post_init__(self) -> None:
        for name in ("delimiter", "quote", "escape"):
            if len(getattr(self, name)) != 1:
                raise SourceError(f"{name} is one character")
        if self.compression not in ("auto", "none", "gzip", "zstd"):
            raise SourceError("compression is auto, none, gzip or zstd")
        if self.sample_size < 1:
            raise SourceError("sample_size is positive")


def compression_of(start: bytes) -> str:
    """By the first bytes, whatever the file is called."""
    return "gzip" if start[:2] == b"\x1f\x8b" else "zstd" if start[:4] == b"\x28\xb5\x2f\xfd" else "none"


def _plain(start: bytes, kind: str) -> bytes:
    """The beginning of the text; a cut-off stream gives what can be had."""
    if kind == "none":
        return start
    out = io.BytesIO()
    try:
        if kind == "gzip":
            with gzip.GzipFile(fileobj=io.BytesIO(start)) as f:
                while len(out.getvalue()) < _SAMPLE_BYTES and (block := f.read(1 << 16)):
                    out.write(block)
        else:
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(start), read_across_frames=True) as f:
                while len(out.getvalue()) < _SAMPLE_BYTES and (block := f.read(1 << 16)):
                    out.write(block)
    except (EOFError, OSError):
        pass
    return out.getvalue()


def _kind(value: str) -> str:
    if re.fullmatch(r"[+-]?\d{1,18}", value):
        return "bigint"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
        return "double"
    if value.lower() in ("true", "false"):
        return "boolean"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        return "date"
    if re.fullmatch(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{1,6})?", value):
        return "timestamp_ntz"
    return "string"


def _column(values: list[str]) -> str:
    kinds = {_kind(v) for v in values if v != ""}
    if kinds == {"bigint", "double"}:
        return "double"
    return kinds.pop() if len(kinds) == 1 else "string"


def sniff(spark: SparkSession, file: File, options: CsvOptions) -> tuple[list[tuple[str, str]], bool, str, bool]:
    """Columns, whether there is a header, the compression, and whether values hold line ends, from a bounded sample
    of one file. (If only values beyond the sample do, reading fails; it doesn't go wrong.)

    Without being told, the first row is a header if it is all text over columns that aren't, or else if its cells
    are distinct identifiers and none occurs again below.
    """
    start = head(spark, file.path, _SAMPLE_BYTES)
    kind = compression_of(start) if options.compression == "auto" else options.compression
    raw = _plain(start, kind)
    whole = len(raw) < _SAMPLE_BYTES and len(start) == file.size
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if whole or e.start < len(raw) - 4:
            raise SourceError(f"{file.path} isn't UTF-8") from None
        text = raw[: e.start].decode("utf-8")
    if not whole:
        text = text[: text.rfind("\n") + 1]
    reader = pycsv.reader(io.StringIO(text, newline=""), delimiter=options.delimiter, quotechar=options.quote, escapechar=None if options.escape == options.quote else options.escape, doublequote=options.escape == options.quote)
    rows = []
    for row in reader:
        if row:
            rows.append(row)
        if len(rows) > options.sample_size:
            break
    if not rows:
        raise SourceError(f"{file.path} is empty")
    if any(len(r) != len(rows[0]) for r in rows):
        raise SourceError(f"{file.path} has rows of different length")
    first, rest = rows[0], rows[1:]
    header = options.header
    if header is None:
        typed = any(_column([r[i] for r in rest]) != "string" and _kind(first[i]) == "string" for i in range(len(first)) if rest)
        distinct = len({c.lower() for c in first}) == len(first) and all(_IDENTIFIER.match(c) for c in first)
        header = all(_kind(c) == "string" and c for c in first) and distinct and (typed or not any(c == r[i] for i, c in enumerate(first) for r in rest))
    if header and (len({c.lower() for c in first}) != len(first) or not all(first)):
        raise SourceError(f"{file.path} has empty or repeated column names")
    data = rest if header else rows
    names = first if header else [f"column{i}" for i in range(len(first))]
    return [(n, _column([r[i] for r in data])) for i, n in enumerate(names)], header, kind, any("\n" in c for r in rows for c in r)


def read_csv(spark: SparkSession, location: str, schema: list[tuple[str, str]] | None = None, **given: object) -> DataFrame:
    """Rows that are short, long or not of their column's type fail the query; so do files whose schemas differ, or
    whose header isn't the given schema's. positional: a given schema's names replace the files'."""
    positional = bool(given.pop("positional", False))
    options = CsvOptions(**given)  # type: ignore[arg-type]
    files = list_files(spark, location)
    with ThreadPoolExecutor(16) as pool:  # samples come from the files' store, many at a time
        found = list(pool.map(lambda f: sniff(spark, f, options), files))
    if schema is None:
        if any(x[0] != found[0][0] for x in found):
            raise SourceError("the files' schemas differ")
        schema = found[0][0]
    own, header, kind, _ = found[0]
    if any(len(x[0]) != len(schema) for x in found):
        raise SourceError(f"the files have {len(own)} columns, not {len(schema)}")
    names = [n for n, _ in schema]
    if header and positional:
        schema = [(n, t) for (n, _), (_, t) in zip(own, schema, strict=True)]
    if any(x[1:3] != found[0][1:3] for x in found):
        raise SourceError("files with and without header, or of several compressions, can't be read together")
    reader = (
        spark.read.schema(", ".join(f"`{n}` {t}" for n, t in schema))
        .option("header", header)
        .option("sep", options.delimiter)
        .option("quote", options.quote)
        .option("escape", options.escape)
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .option("encoding", "UTF-8")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("timestampNTZFormat", "yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS]")
    )
    if any(x[3] for x in found):
        reader = reader.option("multiLine", True)  # such files can't be split
    named = {"gzip": ".gz", "zstd": ".zst"}.get(kind, "")
    if any(f.path.endswith((".gz", ".zst")) != bool(named) or not f.path.endswith(named) for f in files):
        return _by_content(spark, files, kind, reader, schema).toDF(*names)
    paths = [f.path for f in files] if any(c in location for c in "*?[{") else [check_location(location)]
    return reader.csv(paths).toDF(*names)


def _by_content(spark: SparkSession, files: list[File], kind: str, reader, schema: list[tuple[str, str]]) -> DataFrame:
    """Files whose names don't tell their compression: unpacked in the tasks that read them, one file a task (such
    streams can't be split anyway), and parsed by Spark's own reader from lines."""
    lines = spark.read.format("binaryFile").load([f.path for f in files]).select("content")

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                if kind == "gzip":
                    stream = gzip.GzipFile(fileobj=io.BytesIO(content))
                elif kind == "zstd":
                    import zstandard

                    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True)
                else:
                    stream = io.BytesIO(content)
                text, held = io.TextIOWrapper(stream, encoding="utf-8", newline="\n"), []
                for line in text:
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    unpacked = lines.mapInArrow(unpack, "value string")
    return reader.csv(unpacked.rdd.map(lambda r: r[0]))
