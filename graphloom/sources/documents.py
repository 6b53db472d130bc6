"""Document sources: a directory of files becomes documents(doc_id, content, metadata, source_path, error).

Readers are registered by suffix.  Files are read as binary rows and parsed in Arrow batches; a file that fails
gives a row with its error.  No format needs a library.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import clean_text
from graphloom.session import importable

Reader = Callable[[bytes], tuple[str, dict[str, str]]]
READERS: dict[str, Reader] = {}
SCHEMA = "content string, metadata map<string,string>, source_path string, error string"


def reader(suffix: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS[suffix] = f
        return f

    return add


@reader(".docx")
def read_docx(data: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs joined by line feeds, and the core properties."""
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    paragraphs = ["".join(t.text or "" for t in p.iter() if local(t) == "t") for p in body.iter() if local(p) == "p"]
    known = {"creator": "author", "title": "title", "subject": "subject", "revision": "revision", "created": "creation_date", "modified": "modification_date"}
    meta = {known[local(e)]: e.text for e in core if local(e) in known and e.text} if core is not None else {}
    return "\n".join(paragraphs), {**meta, "num_paragraphs": str(len(paragraphs))}


@reader(".pdf")
def read_pdf(data: bytes) -> tuple[str, dict[str, str]]:
    """Pages joined by line feeds, empty ones skipped, and the document's properties."""
    from graphloom.sources.pdf import Pdf

    pdf = Pdf(data)
    pages = [pdf.page_text(p) for p in pdf.pages()]
    if not pages:
        raise ValueError("no pages")
    return "\n".join(p for p in pages if p.strip()), {**pdf.properties(), "num_pages": str(len(pages))}


@reader(".csv")
def read_csv(data: bytes) -> tuple[str, dict[str, str]]:
    """A heading line and a line ``column: value | ...`` for each row, without empty values."""
    frame = pd.read_csv(io.BytesIO(data))
    lines = [f"CSV file with columns: {', '.join(map(str, frame.columns))}"]
    lines += [" | ".join(f"{c}: {v}" for c, v in zip(frame.columns, row) if not pd.isna(v)) for row in frame.itertuples(index=False, name=None)]
    types = ",".join(f"{c}={t}" for c, t in frame.dtypes.items())
    return "\n".join(lines), {"num_rows": str(len(frame)), "num_columns": str(len(frame.columns)), "columns": ",".join(map(str, frame.columns)), "data_types": types}


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def processor_of(path: Column) -> Column:
    """Name of the reader for a path, or null where there is none."""
    out = F.when(F.lit(False), F.lit(""))
    for s in sorted(READERS):
        out = out.when(suffix_of(path) == s, F.lit(s[1:]))
    return out


def parse(paths: pd.Series, contents: pd.Series) -> Iterator[tuple]:
    for path, data in zip(paths, contents):
        suffix = "." + path.lower().rsplit(".", 1)[-1]
        base = {"file_type": suffix[1:], "file_name": re.split(r"[/\\]", path)[-1]}
        try:
            if suffix not in READERS:
                raise ValueError(f"no reader for {suffix}")
            text, meta = READERS[suffix](data)
            yield text, {**base, **meta}, path, None
        except Exception as e:  # a broken file is a row, not a failed job
            yield None, base, path, f"{type(e).__name__}: {e}"


def read_directory(spark: SparkSession, folder: str, patterns: str = "*.pdf,*.docx,*.csv") -> DataFrame:
    """Documents of the files of a folder whose names fit one of the comma-separated patterns; sub-folders are left out."""
    importable(spark)
    glob = "{" + ",".join(p.strip() for p in patterns.split(",")) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = list(parse(f["path"], f["content"]))
            out = pd.DataFrame(rows, columns=["content", "metadata", "source_path", "error"])
            out["file_size"], out["modification_date"] = f["length"].to_numpy(), f["modificationTime"].dt.strftime("%Y-%m-%dT%H:%M:%S").to_numpy()
            yield out

    rows = files.select("path", "modificationTime", "length", "content").mapInPandas(run, SCHEMA + ", file_size long, modification_date string")
    extra = F.create_map(F.lit("file_size"), F.col("file_size").cast("string"), F.lit("modification_date"), F.col("modification_date"))
    keys = F.map_filter(extra, lambda k, v: ~F.coalesce(F.map_contains_key("metadata", k), F.lit(False)))
    made = rows.withColumn("metadata", F.map_concat("metadata", keys)).withColumn("content", clean_text(F.col("content")))
    return made.select(document_id(F.col("source_path"), F.col("content")).alias("doc_id"), "content", "metadata", "source_path", "error")


def document_id(source_path: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_path, content), 256)


def row_text(df: DataFrame) -> Column:
    """``column: value | ...`` of a table's row, without nulls."""
    return F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in df.columns])


def profile(df: DataFrame) -> DataFrame:
    """num_rows, num_columns, columns, data_types of a table."""
    types = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.lit(t) for _, t in df.dtypes]))
    return df.agg(F.count("*").alias("num_rows")).select("num_rows", F.lit(len(df.columns)).alias("num_columns"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), types.alias("data_types"))


def processing_summary(results: DataFrame) -> DataFrame:
    """total, succeeded, failed, entities, relationships of processed documents."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"), F.coalesce(F.sum("relationship_count"), F.lit(0)).alias("relationships"))
