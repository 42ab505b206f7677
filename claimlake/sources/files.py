"""Claim folders as DataFrames, and what is written back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .snapshots import Snapshots

#: Page size and line height of documents without layout, and units of length: fixed values.
PAGE_WIDTH, LINE_HEIGHT, ROW_HEIGHT, EMU_PER_INCH, POINTS = 612.0, 12.0, 20.0, 914400, 72
#: How far apart characters of a word may lie: fixed values.
X_TOLERANCE, Y_TOLERANCE = 1.1, 2.0
LAYOUT = "pos int, seq int, kind string, text string, rows array<array<string>>, image binary, width double, height double, image_index int, has_break boolean, page int, x0 double, y0 double, x1 double, y1 double"


def with_index(files: DataFrame, claim: str = "claim_id", name: str = "name") -> DataFrame:
    """Supported files numbered from 0 by lower-cased name within their claim."""
    w = Window.partitionBy(claim).orderBy(F.lower(name), name)
    return files.where(text.file_ext(F.col(name)).isin(*DECODERS)).withColumn("doc_idx", F.row_number().over(w) - 1)


def list_claims(spark: SparkSession, root: str) -> DataFrame:
    """(claim_id, name, ext, path, length, content) of the supported files one level under each claim's folder."""
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in DECODERS]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(any_case)}}}").load(f"{root}/*/")
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("claim_id"), text.file_name(F.col("path")).alias("name"), "path", "length", "content")
    return with_index(named.withColumn("ext", text.file_ext(F.col("name"))))


def decode_docx(content: bytes) -> list[dict]:
    """Body elements of a DOCX file in order: paragraphs' texts and images, tables' cells, and page breaks."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    spaces = ("wordprocessingml/2006/main", "drawingml/2006/main", "officeDocument/2006/relationships", "drawingml/2006/wordprocessingDrawing")
    w, a, r, wp = (f"{{http://schemas.openxmlformats.org/{space}}}" for space in spaces)
    pack = zipfile.ZipFile(io.BytesIO(content))
    parts = {}
    if "word/_rels/document.xml.rels" in pack.namelist():
        parts = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(pack.read("word/_rels/document.xml.rels"))}
    body = ElementTree.fromstring(pack.read("word/document.xml")).find(f"{w}body")
    out = []
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    signs = {f"{w}tab": "\t", f"{w}ptab": "\t", f"{w}cr": "\n", f"{w}noBreakHyphen": "-"}

    def run(node) -> str:
        """Text of a run within a cell: tabs and line breaks count, page and column breaks do not."""
        shown = lambda x: (x.text or "") if x.tag == f"{w}t" else "\n" * (x.get(f"{w}type", "textWrapping") == "textWrapping") if x.tag == f"{w}br" else signs.get(x.tag, "")
        return "".join(map(shown, node))

    def in_cell(cell) -> str:
        """Text of a cell's own paragraphs; tables within the cell are left out."""
        runs = lambda p: (r for x in p for r in ([x] if x.tag == f"{w}r" else x.findall(f"{w}r") if x.tag == f"{w}hyperlink" else []))
        return "\n".join("".join(map(run, runs(p))) for p in cell.findall(f"{w}p"))

    for pos, node in enumerate(body if body is not None else []):
        if node.tag == f"{w}p":
            breaks = any(b.get(f"{w}type") == "page" for b in node.iter(f"{w}br"))
            for section in node.iter(f"{w}sectPr"):
                kind = section.find(f"{w}type")
                breaks |= kind is None or kind.get(f"{w}val", "nextPage") in ("nextPage", "evenPage", "oddPage")
            out.append({"pos": pos, "kind": "break" if breaks else "none", "has_break": breaks})
            for index, drawing in enumerate(node.iter(f"{w}drawing")):
                blip, extent = next(drawing.iter(f"{a}blip"), None), next(drawing.iter(f"{wp}extent"), None)
                if blip is None or not blip.get(f"{r}embed"):
                    continue
                target = parts.get(blip.get(f"{r}embed"))
                name = posixpath.normpath(posixpath.join("/word", target)).lstrip("/") if target else ""
                size = [float(extent.get(k, 0)) / EMU_PER_INCH * POINTS if extent is not None else 0.0 for k in ("cx", "cy")]
                out.append({"pos": pos, "kind": "image", "image": pack.read(name) if name in pack.namelist() else None, "width": size[0], "height": size[1], "image_index": index})
            if said(node).strip():
                out.append({"pos": pos, "kind": "text", "text": said(node)})
        elif node.tag == f"{w}tbl":
            rows: list[list[str]] = []
            for row in node.findall(f"{w}tr"):
                cells: list[str] = []  # a merged cell's text stands in every place that it spans
                for cell in row.findall(f"{w}tc"):
                    span, down = cell.find(f"{w}tcPr/{w}gridSpan"), cell.find(f"{w}tcPr/{w}vMerge")
                    above = rows[-1][len(cells) : len(cells) + 1] if rows and down is not None and down.get(f"{w}val", "continue") == "continue" else []
                    own = above or [in_cell(cell).strip()]
                    cells += own * (int(span.get(f"{w}val", 1)) if span is not None else 1)
                rows.append(cells)
            if rows:
                out.append({"pos": pos, "kind": "table", "rows": rows})
    page = 1
    for x in out:
        page += bool(x.get("has_break"))
        high = ROW_HEIGHT * len(x["rows"]) if x["kind"] == "table" else LINE_HEIGHT
        x |= {"page": page, "x0": 0.0, "y0": float(x["pos"]), "x1": PAGE_WIDTH, "y1": x["pos"] + high}
    kept = [x for x in out if x["kind"] != "none"]
    return [x | {"seq": seq} for seq, x in enumerate(kept)]


def _image_bytes(content: bytes) -> Callable[[int], list[bytes | None]]:
    """Bytes of a page's images by their place, as far as an optional library can read them."""
    try:
        import io

        import pypdf

        pages = pypdf.PdfReader(io.BytesIO(content)).pages
    except Exception:  # without the library, or of a file that it can't read, images have no bytes
        return lambda page: []

    def of_page(page: int) -> list[bytes | None]:
        out: list[bytes | None] = []
        try:
            for image in pages[page].images:
                out.append(_bytes_of(image))
        except Exception:  # the images from here on have no bytes
            return out
        return out

    return of_page


def _bytes_of(image) -> bytes | None:
    try:
        return image.data
    except Exception:  # this image has no bytes
        return None


def decode_pdf(content: bytes) -> list[dict]:
    """Layout of a PDF file; needs an optional library, and says so where it is missing."""
    try:
        import pdfplumber
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs the optional library pdfplumber") from missing
    import io

    out, image_bytes = [], _image_bytes(content)
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for number, page in enumerate(pdf.pages, 1):
            tables = page.find_tables()
            boxes = [t.bbox for t in tables]
            for t in tables:
                out.append({"kind": "table", "rows": t.extract(), "page": number} | dict(zip(("x0", "y0", "x1", "y1"), t.bbox, strict=True)))
            inside = lambda o, boxes=boxes: any(o["x0"] < b[2] and o["x1"] > b[0] and o["top"] < b[3] and o["bottom"] > b[1] for b in boxes)
            clear = page.filter(lambda o, inside=inside: o.get("object_type") != "char" or not inside(o))
            for word in clear.extract_words(x_tolerance=X_TOLERANCE, y_tolerance=Y_TOLERANCE, keep_blank_chars=False, use_text_flow=True):
                out.append({"kind": "word", "text": word["text"], "page": number, "x0": word["x0"], "y0": word["top"], "x1": word["x1"], "y1": word["bottom"]})
            raw = image_bytes(number - 1) if page.images else []
            for index, image in enumerate(page.images):
                box = [float(image.get(k) or 0.0) for k in ("x0", "top", "x1", "bottom")]
                own = {"image_index": index, "image": raw[index] if index < len(raw) else None, "width": float(image.get("width") or 0), "height": float(image.get("height") or 0)}
                out.append({"kind": "image", "page": number} | own | dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)))
    for pos, x in enumerate(out):
        x["pos"] = pos
    return out


DECODERS: dict[str, Callable[[bytes], list[dict]]] = {"pdf": decode_pdf, "docx": decode_docx}


def register(ext: str, decoder: Callable[[bytes], list[dict]]) -> None:
    """Add a format: its decoder maps bytes to layout rows."""
    DECODERS[ext.lower()] = decoder


def parser_label(name: Column) -> Column:
    """How the parser of a file is shown, by what follows the last dot of its name (all of it without one); null if there is none."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(ext.isin(*DECODERS), F.concat(F.lit("<DocumentParser:"), F.upper(ext), F.lit(">")))


def decode(files: DataFrame, strict: bool = False, *keys: str) -> DataFrame:
    """Layout rows of files (keys, name, content) by extension; a file that fails gives one row with its error.

    With ``strict`` an unsupported extension raises instead.
    """
    schema = ", ".join([*(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys), LAYOUT, "error string"])
    names = [part.split()[0] for part in LAYOUT.replace("array<array<string>>", "cells").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, file in batch.iterrows():
                ext = file["name"].rsplit(".", 1)[-1].lower()
                own = {k: file[k] for k in keys}
                if ext not in DECODERS and strict:
                    raise ValueError(f"unsupported extension {ext!r}; supported: {sorted(DECODERS)}")
                try:
                    rows = [own | {n: x.get(n) for n in names} | {"error": None} for x in DECODERS[ext](file["content"])]
                except Exception as failed:
                    rows = [own | dict.fromkeys(names) | {"error": f"{type(failed).__name__}: {failed}"}]
                yield pd.DataFrame(rows, columns=[*keys, *names, "error"], dtype=object)

    return files.select(*dict.fromkeys([*keys, "name", "content"])).mapInPandas(run, schema)


def write_by_claim(rows: DataFrame, path: str, mode: str, claim: str = "claim_id", form: str = "parquet") -> None:
    """Write rows into one folder per claim: ``overwrite`` replaces the claims at hand only, ``append`` adds to them."""
    out = rows.write.mode(mode).partitionBy(claim).format(form)
    (out.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else out).save(path)


def clear(claims: DataFrame, *paths: str, claim: str = "claim_id") -> None:
    """Remove what tables by claim hold of the claims at hand; others stay. Only folders are removed, one call for each."""
    spark = claims.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for row in claims.select(claim).distinct().toLocalIterator():
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{claim}={row[0]}")
            folder.getFileSystem(conf).delete(folder, True)


def processed_root(root: str) -> str:
    """Where results of the claims under a folder go: ``processed`` beside it."""
    return root.rstrip("/").rsplit("/", 1)[0] + "/processed"


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by claim that earlier runs left, as snapshots or as folders, empty where there is none yet."""
    versions = Snapshots(spark, path, schema)
    if versions.version():
        return versions.read()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(claim_id, name, content) of text files one level under each claim's folder, such as diaries and ledgers."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("claim_id"), text.file_name(F.col("path")).alias("name"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path and their sizes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
