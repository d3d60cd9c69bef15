"""Files to documents and back: inventory, text and DOCX reading, extraction, payloads, sinks."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_spark.functions import text as X

EXTRACTED = (".pdf", ".docx", ".txt")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: a fresh local one for a local master, an error on a cluster,
    whose machines share no temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("dossier.files", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("dossier.files", base)
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The path and its file system."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(context._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, system = _path(spark, path)
    system.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the application ends goes then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p, system = _path(spark, path)
    system.mkdirs(p.getParent())
    system.mkdirs(p)
    system.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and safe from lost executors. The path is
    the result's `scratch_path`."""
    path = scratch(df.sparkSession, name)
    df.write.mode("append").option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


FOLDED = 32  # Spark counts 4 MB for opening a file, so a task would get 32 small ones; so many such tasks become one


def _binary(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tasks = files.select("path").rdd.getNumPartitions()
    return files.coalesce(max(1, spark.sparkContext.defaultParallelism, -(-tasks // FOLDED)))


def _plain(path: Column) -> Column:
    """A local path without its scheme; others as they are."""
    return F.regexp_replace(path, "^file:/*", "/")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, client_id, rel (below the client's folder), folder, name, suffix, size_bytes, mtime of every file below root,
    hidden ones and those in hidden folders left out; the content is not read (S1). Spark's file source also hides names
    that begin with _."""
    path = _plain(F.col("path"))
    rel = F.replace(path, _plain(F.lit(root.rstrip("/") + "/")), F.lit(""))
    f = _binary(spark, root).select(path.alias("path"), rel.alias("rel"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    f = f.filter(~F.col("rel").rlike(r"(^|/)\."))
    name = F.element_at(F.split("rel", "/"), -1)
    parts = F.split("rel", "/")
    below = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return f.select("path", F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(1))).alias("client_id"), F.when(F.size(parts) > 1, below).otherwise(name).alias("rel"), F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(2))).otherwise("").alias("folder"), name.alias("name"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("suffix"), "size_bytes", "mtime")


def parse_targets(files: DataFrame, name: str = "source.docx") -> DataFrame:
    """Folders that hold the file to parse."""
    return files.filter(F.col("name") == name).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().orderBy("folder")


def as_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_paragraphs(content: bytes) -> list[dict]:
    """Non-empty paragraphs with style, bold, mean font size and numbering prefix, then table rows joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                if (n := s.find(f"{W}name")) is not None:
                    names[s.get(f"{W}styleId")] = n.get(f"{W}val")
    out = []
    text_of = lambda node: "".join((t.text or "") if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in node.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
    for p in body.findall(f"{W}p") if body is not None else []:
        text = text_of(p).strip()
        if not text:
            continue
        style = p.find(f"{W}pPr/{W}pStyle")
        runs = [r for r in p.iter(f"{W}r") if text_of(r).strip()]
        sizes = [int(s.get(f"{W}val")) / 2 for r in runs if (s := r.find(f"{W}rPr/{W}sz")) is not None]
        bold = any((b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val", "1") not in ("0", "false") for r in runs)
        ident = style.get(f"{W}val") if style is not None else "Normal"
        out.append({"text": text, "style_name": names.get(ident, ident), "is_bold": bold, "font_size": sum(sizes) / len(sizes) if sizes else None, "in_table": False})
    for row in body.iter(f"{W}tr") if body is not None else []:
        cells = [text_of(c).strip() for c in row.findall(f"{W}tc")]
        if any(cells):
            out.append({"text": " | ".join(cells), "style_name": "Table", "is_bold": False, "font_size": None, "in_table": True})
    return out


PARAGRAPHS = "path string, pos int, text string, style_name string, is_bold boolean, font_size double, in_table boolean, error string"
PIECE_ROWS, PIECE_CHARS = 2000, 1 << 20  # a task's paragraphs go out from so many on


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    """Paragraph rows of every .docx below root."""
    return parse_docx(_binary(spark, root).filter(F.lower("path").endswith(".docx")))


def docx_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraph rows of batches of files (path, content), in pieces."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("style_name", pa.string()), ("is_bold", pa.bool_()), ("font_size", pa.float64()), ("in_table", pa.bool_()), ("error", pa.string())])
    for batch in batches:
        rows, chars = [], 0
        for path, content in zip(batch["path"], batch["content"], strict=True):  # as Python values one file at a time
            path = path.as_py()
            try:
                found = [{"path": path, "pos": i, **p, "error": None} for i, p in enumerate(docx_paragraphs(content.as_py()))]
            except Exception as e:  # noqa: BLE001  whatever is wrong with a file stays with its row
                found = [{"path": path, "pos": -1, "text": "", "style_name": None, "is_bold": False, "font_size": None, "in_table": False, "error": type(e).__name__}]
            rows += found
            chars += sum(len(r["text"]) for r in found)
            if len(rows) >= PIECE_ROWS or chars >= PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_docx(files: DataFrame) -> DataFrame:
    """Paragraph rows of files (path, content); a broken file is one row with its error."""
    p = files.select("path", "content").mapInArrow(docx_rows, PARAGRAPHS)
    return p.withColumn("is_all_caps", X.all_caps(F.col("text"))).withColumn("numbering_prefix", X.numbering(F.col("text")))


def docx_texts(paragraphs: DataFrame) -> DataFrame:
    """(path, text, error) of paragraph rows: paragraphs, then table rows, one a line (S3)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return paragraphs.groupBy("path").agg(F.array_join(ordered, "\n").alias("text"), F.max("error").alias("error"))


def write_files(files: DataFrame, root: str) -> None:
    """Each row's content at its place below root, written by the tasks: files (rel, content). A task that runs again
    writes the same."""
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, base = fs.FileSystem.from_uri(root)
        last = None
        for pdf in batches:
            for rel, content in zip(pdf["rel"], pdf["content"], strict=True):
                name = f"{base}/{rel}"
                folder = name.rsplit("/", 1)[0]
                if folder != last:
                    at.create_dir(folder, recursive=True)
                    last = folder
                with at.open_output_stream(name) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("rel", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def extract(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, size_bytes, mtime, extractor, text, text_sha256, error) of every supported file that is not hidden;
    failures stay as rows (S5). PDF pages come from an already extracted table, so .pdf rows say extractor 'pages'."""
    shown = ~F.replace(_plain(F.col("path")), _plain(F.lit(root.rstrip("/") + "/")), F.lit("")).rlike(r"(^|/)\.")
    return _extracted(_binary(spark, root).filter(shown).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content"))


def _extracted(files: DataFrame) -> DataFrame:
    """Extraction rows of files (path, size_bytes, mtime, content): one pass, in which each file is opened once."""
    f = files.withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).filter(F.col("ext").isin(*EXTRACTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, texts, errors, kept, chars = 0, [], [], [], 0
            for i, (ext, content) in enumerate(zip(batch["ext"], batch["content"], strict=True)):
                text = error = raw = None
                if ext.as_py() == ".txt":
                    raw = content.as_py()
                elif ext.as_py() == ".docx":
                    try:
                        text = "\n".join(p["text"] for p in docx_paragraphs(content.as_py()))
                    except Exception as e:  # noqa: BLE001  whatever is wrong with a file stays with its row
                        error = type(e).__name__
                texts.append(text), errors.append(error), kept.append(raw)
                chars += len(text or raw or "")
                if len(texts) >= PIECE_ROWS or chars >= PIECE_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(lo, len(texts))
                    cols = [part[c] for c in ("path", "ext", "size_bytes", "mtime")] + [pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "ext", "size_bytes", "mtime", "content", "docx", "error"])
                    lo, texts, errors, kept, chars = i + 1, [], [], [], 0

    d = f.select("path", "ext", "size_bytes", "mtime", "content").mapInArrow(run, "path string, ext string, size_bytes long, mtime timestamp, content binary, docx string, error string")
    extractor = F.when(F.col("ext") == ".txt", "text").when(F.col("ext") == ".pdf", "pages").when(F.col("error").isNull(), "docx").otherwise("error")
    text = F.when(F.col("ext") == ".txt", as_text(F.col("content"))).otherwise(F.coalesce("docx", F.lit("")))
    d = d.select("path", "ext", "size_bytes", "mtime", extractor.alias("extractor"), X.normalise_newlines(text).alias("text"), "error")
    return d.withColumn("text_sha256", F.sha2("text", 256))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mtime) of the files below root; nothing is read."""
    return _binary(spark, root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def contents(listing: DataFrame) -> DataFrame:
    """listing (path, size_bytes, mtime) with the files' content, read by the tasks. A file that is gone by then is left out."""
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 16):
                part = pdf.iloc[lo : lo + 16].copy()
                read = []
                for path in part["path"]:
                    at, place = fs.FileSystem.from_uri(re.sub("^file:/*", "/", path) if path.startswith(("file:", "/")) else quote(path, safe=":/"))
                    try:
                        with at.open_input_stream(place) as file:
                            read.append(file.read())
                    except FileNotFoundError:
                        read.append(None)
                part["content"] = read
                yield part

    return listing.select("path", "size_bytes", "mtime").mapInPandas(run, "path string, size_bytes long, mtime timestamp, content binary").filter("content is not null")


def refresh(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The extraction of a listing (path, size_bytes, mtime), given that of an earlier one: rows of extract(), and was_read.

    A file of the same path, size and time keeps its row and is not opened; new and changed ones are read; what is not
    listed any more drops out. The result is the next snapshot.
    """
    now = listing.select("path", "size_bytes", "mtime").filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*EXTRACTED))
    key = ["path", "size_bytes", "mtime"]
    kept = snapshot.drop("was_read").join(now, key, "left_semi")
    read = _extracted(contents(written(now.join(snapshot.select(*key), key, "left_anti"), "changed")))
    return kept.withColumn("was_read", F.lit(False)).unionByName(read.withColumn("was_read", F.lit(True)))


def route(ext: Column) -> Column:
    """How a file of this suffix is read: its kind without the dot, or skipped."""
    low = F.lower(ext)
    return F.when(low.isin(*EXTRACTED), F.substring(low, 2, 9)).otherwise(F.lit("skipped"))


def extraction_counts(seen: DataFrame) -> DataFrame:
    """ok, errors, skipped, total of the files seen: (extractor), null for those that are not read."""
    bad, kept = F.col("extractor") == "error", F.col("extractor").isNotNull()
    return seen.agg(F.count_if(kept & ~bad).alias("ok"), F.count_if(kept & bad).alias("errors"), F.count_if(~kept).alias("skipped"), F.count("*").alias("total"))


def with_text(docs: DataFrame, in_sources: str = "in_sources") -> DataFrame:
    """Documents with text (client_id, text, in_sources): those below the client's sources, or all where none of these has
    text (F4). A client without any text is not in the result; clients_without_text() names them."""
    d = docs.filter(X.strip(F.coalesce("text", F.lit(""))) != "")
    own = d.filter(F.col(in_sources))
    return own.unionByName(d.filter(~F.col(in_sources)).join(own.select("client_id").distinct(), "client_id", "left_anti"))


def clients_without_text(docs: DataFrame) -> DataFrame:
    """(client_id, error) of clients none of whose documents has text."""
    n = docs.groupBy("client_id").agg(F.count_if(X.strip(F.coalesce("text", F.lit(""))) != "").alias("n"))
    return n.filter("n = 0").select("client_id", F.lit("no document with text").alias("error"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """Whole texts of page-wise documents (path, page, text): non-empty pages joined by a blank line."""
    full = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), lambda t: X.strip(t) != "")
    return pages.groupBy("path").agg(F.array_join(full, "\n\n").alias("text"), F.count("*").alias("n_pages"))


def read_payload(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents of extraction payloads, one JSON object a line, under either of their two spellings.
    A payload spread over lines is read with multi_line."""
    d = spark.read.option("multiLine", multi_line).json(path).select(F.explode("documents").alias("d")).select("d.*")
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in d.columns], F.lit(None).cast("string"))
    return d.select("path", pick("text").alias("text"), pick("text_sha256", "hash").alias("text_sha256"), pick("mtime_iso", "mtime").alias("mtime"), pick("extractor").alias("extractor"))


# ---------------------------------------------------------------- sinks


def corpus_lines(docs: DataFrame) -> DataFrame:
    """===== FILE: path ===== and the text of each non-empty document."""
    return docs.filter(X.strip(F.col("text")) != "").select("path", F.format_string("===== FILE: %s =====\n%s\n", "path", "text").alias("value"))


def write_corpus(docs: DataFrame, path: str) -> None:
    corpus_lines(docs).orderBy("path").select("value").write.text(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON a row, a folder for each value of `by`."""
    w = df.write
    (w.partitionBy(by) if by else w).json(path)


def write_context(exported: DataFrame, path: str) -> None:
    """Exported contexts, one JSON object a client and query."""
    write_json(exported, path)


def write_csv(df: DataFrame, path: str) -> None:
    """Batch table with a header, - where a value is missing."""
    df.select([F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns]).write.option("header", True).csv(path)
