"""What the bytes of PDF files tell without a reader of them: pages, whether they are scans, and how sure that is."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Streams that are inflated, contents that are looked at, and the longest of these.
MOST_STREAMS, MOST_CONTENTS, LONGEST = 400, 24, 2 * 1024 * 1024
#: A scan has an image for this share of its pages; it is an invisible layer if this share of its contents draws none that shows.
IMAGES, INVISIBLE, LARGE = 0.8, 0.8, 120 * 1024
# Names in the producer of a scan.
SCANNERS = re.compile(
    r"(?i)(scan|abbyy|finereader|omnipage|paper capture|ocrmypdf|tesseract|readiris|naps2|kofax|captiva|xerox|ricoh|konica|kyocera|canon|epson|brother|sharp mx|hp digital sending|imagerunner|bizhub)"
)
KINDS = StructType([StructField("pages", IntegerType()), StructField("kind", StringType()), StructField("confidence", StringType()), StructField("reason", StringType())])


def inflated(data: bytes) -> str:
    """The text of a compressed stream as far as it decodes; what follows its end is left alone."""
    engine, out = zlib.decompressobj(), b""
    try:
        out = engine.decompress(data, 64 * LONGEST)
    except zlib.error:
        for k in range(0, len(data), 256):  # keep what comes before the fault
            try:
                engine = engine if k else zlib.decompressobj()
                out += engine.decompress(data[k : k + 256], 64 * LONGEST)
            except zlib.error:
                break
    return out.decode("latin-1")


def _dictionary(text: str, at: int, end: int) -> str | None:
    begin = text.rfind("<<", 0, at)
    return None if begin < 0 else text[begin:end]


def object_streams(text: str, data: bytes) -> str:
    """The content of the file's compressed object streams."""
    out, at, mark = [], 0, re.compile(r"/Type\s*/ObjStm\b")
    while (found := mark.search(text, at)) and len(out) < MOST_STREAMS:
        at = found.end()
        stream = text.find("stream", found.start())
        own = _dictionary(text, found.start() + 2, stream) if stream >= 0 else None
        if own is None or "FlateDecode" not in own:
            continue
        start = stream + len("stream")
        start += text[start : start + 1] == "\r"
        start += text[start : start + 1] == "\n"
        length = re.search(r"/Length\s+(\d+)(?!\s+\d+\s+R)", own)
        end = start + int(length[1]) if length else text.find("endstream", start)
        if end > start:
            out.append(inflated(data[start:end]))
            at = end
    return "\n".join(out)


def page_count(text: str) -> int:
    """The largest count of a node of the page tree, or the pages where there is none."""
    best = 0
    for found in re.finditer(r"/Type\s*/Pages\b", text):
        count = re.search(r"/Count\s+(\d+)", text[max(0, text.rfind("<<", 0, found.start() + 2)) : found.start() + 400])
        best = max(best, int(count[1]) if count else 0)
    return best or len(re.findall(r"/Type\s*/Page(?![s\w])", text))


def text_layers(text: str, data: bytes) -> tuple[int, int]:
    """Of a few contents that draw text, their number and those of them in which no text shows."""
    drawing = hidden = at = 0
    mark = re.compile(r"\bstream\r?\n")
    while (found := mark.search(text, at)) and drawing < MOST_CONTENTS:
        at = found.end()
        own = _dictionary(text, found.start() + 2, found.start())
        if own is None or "FlateDecode" not in own or re.search(r"/Subtype\s*/Image|/Type\s*/(ObjStm|XRef|XObject)|/Length[123]\b", own):
            continue
        end = text.find("endstream", at)
        if end <= at or end - at > LONGEST:
            continue
        content, at = inflated(data[at:end]), end
        if re.search(r"\bBT\b", content):
            modes = re.findall(r"\b([0-7])\s+Tr\b", content)
            drawing += 1
            hidden += bool(modes) and set(modes) == {"3"}
    return drawing, hidden


def probe(data: bytes | None) -> dict | None:
    """pages, kind (scan or text), confidence and reason; null for what has no pages, as for what is no PDF."""
    if not data or b"%PDF-" not in data[:1024]:
        return None
    own = data.decode("latin-1")
    pages, text = page_count(own), own
    if re.search(r"/Type\s*/ObjStm\b", own):
        text = own + "\n" + object_streams(own, data)
        pages = pages or page_count(text)
    if not pages:
        return None
    fonts = len(re.findall(r"/Type\s*/Font\b", text)) + len(re.findall(r"/FontDescriptor\b", text))
    images = len(re.findall(r"/Subtype\s*/Image\b", text))
    drawing, hidden = text_layers(own, data)
    scanner = any(SCANNERS.search(x) for x in re.findall(r"/(?:Producer|Creator)\s*\(([^)]{0,200})\)", text))
    full = images >= pages * IMAGES
    rules = (
        (fonts == 0, "scan", "high", "no fonts"),
        (full and drawing >= min(3, pages) and hidden >= drawing * INVISIBLE, "scan", "high", "an invisible text layer over images"),
        ("GlyphLessFont" in text, "scan", "high", "a font without glyphs"),
        (scanner and full, "scan", "low", "made by a scanner"),
        (images >= pages and fonts <= 2 and len(data) / pages > LARGE, "scan", "low", "a large image a page"),
        (True, "text", "low" if images > pages else "high", "a text layer"),
    )
    _, kind, confidence, reason = next(r for r in rules if r[0])
    return {"pages": pages, "kind": kind, "confidence": confidence, "reason": reason}


@F.pandas_udf(KINDS)
def _probed(data: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(KINDS.names)
    return pd.DataFrame([probe(None if d is None else bytes(d)) or none for d in data], columns=KINDS.names).astype({"pages": "Int32"})


def probed(data: Column) -> Column:
    """struct(pages, kind, confidence, reason) of a file's bytes; its fields are null where there is nothing to tell."""
    return _probed(data)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, pages, kind, confidence, reason) of the PDF files below a path; files are read by Spark's binary source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", probed(F.col("content")).alias("p")).select("path", "length", "p.*")
