"""Reading a folder of files: listing, text, and the text inside office documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.columns import trim
from corpusloom.functions.paths import document_kind, lower_extension

# Fixed values.
HIDDEN_NAMES = ["index.json", "embeddings.json"]
# Types whose text comes from other programs; extracted text is accepted as a table instead.
FOREIGN_KINDS = ["pdf", "image"]


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All visible files below a folder: (path, kind, modified_at, size_bytes, bytes).

    Hidden files and folders and the reserved index files are left out. Bytes are only read if they are used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root), "/+$", "")
    # The reader gives absolute locations; a corpus path starts below the root.
    start = F.instr("path", base) + F.length(base) + 1
    relative = F.url_decode(F.replace(F.substring("path", start, F.length("path")), F.lit("+"), F.lit("%2B")))
    name = F.substring_index(relative, "/", -1)
    visible = ~F.regexp_like(relative, F.lit("(^|/)\\.")) & ~name.isin(*HIDDEN_NAMES)
    return files.filter(visible).select(
        relative.alias("path"), document_kind(lower_extension(relative)).alias("kind"),
        F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"),
    )


def looks_binary(data: Column, sniff_bytes: int | None = None) -> Column:
    """A NUL byte, or more than two percent of control bytes; in all of the content unless `sniff_bytes` bounds it."""
    seen = F.decode(data if sniff_bytes is None else F.substring(data, 1, sniff_bytes), "ISO-8859-1")  # a character a byte
    control = F.length(F.regexp_replace(seen, "[^\\x00-\\x08\\x0E-\\x1F]+", ""))
    return (F.length(seen) > 0) & (F.contains(seen, F.lit("\x00")) | (control * 100 > F.length(seen) * 2))


def decode_text(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text of text and table files as (path, kind, content, error, …); invalid bytes become replacement characters.

    Files of any size are read; `max_bytes` refuses larger ones.
    """
    too_large = F.concat(F.lit("File is too large to open in editor ("), F.col("size_bytes").cast("string"), F.lit(" bytes)."))
    refused = F.lit(False) if max_bytes is None else F.col("size_bytes") > max_bytes
    error = F.when(refused, too_large).when(looks_binary(F.col("bytes")), "Unsupported binary file (preview is not available yet).")
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return files.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), text)).drop("bytes")


_TAG = re.compile(r"<[^>]*>?|>")
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def _xml_text(data: bytes) -> str:
    text = _TAG.sub(" ", data.decode("utf-8"))
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return " ".join(text.split())


# The parts of an office file that hold text, in reading order.
OFFICE_PARTS = {
    "docx": ["word/document\\.xml"],
    "pptx": ["ppt/slides/slide[^/]*\\.xml"],
    "xlsx": ["xl/sharedStrings\\.xml", "xl/workbook\\.xml", "xl/worksheets/sheet[^/]*\\.xml"],
}


def _office_text(data: bytes, kind: str) -> tuple[str | None, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = sorted(archive.namelist())
            parts = [n for pattern in OFFICE_PARTS[kind] for n in names if re.fullmatch(pattern, n)]
            texts = [t for n in parts if (t := _xml_text(archive.read(n)))]
    except (zipfile.BadZipFile, UnicodeDecodeError, KeyError) as error:
        return None, f"Could not extract text from this {kind.upper()} file: {error}"
    # Blank lines between parts are dropped again, as everywhere in extracted text.
    return ("\n".join(texts), None) if texts else (None, f"This {kind.upper()} file does not contain readable text.")


def extract_office(files: DataFrame) -> DataFrame:
    """Text of office files (kind docx, pptx, xlsx), or why there is none."""
    schema = "path string, kind string, modified_at timestamp, size_bytes long, content string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [_office_text(bytes(data), kind) for data, kind in zip(frame["bytes"], frame["kind"])]
            yield frame.drop(columns="bytes").assign(content=[p[0] for p in pairs], error=[p[1] for p in pairs])

    return files.select("path", "kind", "modified_at", "size_bytes", "bytes").mapInPandas(run, schema)


def read_corpus(spark: SparkSession, root: str, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (path, kind, content, modified_at, size_bytes) and the files that gave none (path, error).

    ``extracted(path, content)`` supplies the text of PDFs and images, read by other programs.
    """
    files = scan_corpus(spark, root)
    columns = ["path", "kind", "modified_at", "size_bytes", "content", "error"]
    office = list(OFFICE_PARTS)
    plain = decode_text(files.filter(~F.col("kind").isin(*office, *FOREIGN_KINDS))).select(*columns)
    zipped = extract_office(files.filter(F.col("kind").isin(*office))).select(*columns)
    foreign = files.filter(F.col("kind").isin(*FOREIGN_KINDS)).drop("bytes")
    given = extracted if extracted is not None else spark.createDataFrame([], "path string, content string")
    other = foreign.join(given.select("path", "content"), "path", "left").withColumn(
        "error", F.when(F.col("content").isNull() | (trim("content") == ""), "No extracted text was supplied for this file.")
    ).select(*columns)
    everything = plain.unionByName(zipped).unionByName(other)
    good = everything.filter(F.col("error").isNull()).drop("error")
    return good, everything.filter(F.col("error").isNotNull()).select("path", "error")


def read_csv_as_text(spark: SparkSession, location: str) -> DataFrame:
    """CSV files as whole texts; they are documents here, never parsed into columns."""
    return spark.read.text(location, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
