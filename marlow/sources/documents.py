"""Sources: XML trees of files, feeds, wrapped JSON, binary files, and rows out of root attributes."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import safe_date
from ..functions.slices import sliced

ROOT_SCHEMA = T.StructType([T.StructField("tag", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("title", T.StringType())])


def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, version, xml): the first XML file of every directory; the version is the directory's name."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml").select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("path"))
    files = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    first = files.select("folder", "path").groupBy("folder").agg(F.min("path").alias("path"))
    return files.join(first, ["folder", "path"], "left_semi").withColumn("version", F.regexp_extract("folder", "([^/]+)$", 1).try_cast("double").cast("int"))


def _roots(xml: pd.Series) -> pd.DataFrame:
    """The root's name and attributes, and the document's title; nulls where the text is not XML."""
    def one(x: str | None) -> tuple:
        try:
            root = ET.fromstring(x) if x else None
        except ET.ParseError:
            root = None
        if root is None:
            return None, None, None
        title = next((" ".join("".join(e.itertext()).split()) for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] in ("billref", "title")), None)
        return root.tag.rpartition("}")[2], {k.rpartition("}")[2]: v for k, v in root.attrib.items()}, title

    return pd.DataFrame([one(x) for x in xml], columns=["tag", "attributes", "title"])


xml_root = sliced(_roots, ROOT_SCHEMA, frame=True)


def instruments(files: DataFrame, xml_col: str = "xml") -> DataFrame:
    """One row per document from its root attributes: fallbacks, flags by comparison, dates that may fail."""
    rows = files.withColumn("r", xml_root(xml_col))

    def attr(*names: str) -> Column:
        return F.coalesce(*(F.element_at("r.attributes", n) for n in names))

    dates = {"date_first_valid": "date.first.valid", "date_as_at": "date.as.at", "date_assent": "date.assent", "date_gazetted": "date.gazetted", "date_terminated": "date.terminated", "date_imprint": "date.imprint", "date_signed": "date.signed"}
    return rows.filter("r.tag is not null").select(
        *files.columns,
        attr("id").alias("govt_id"), F.col("r.tag").alias("type"), F.col("r.title").alias("title"), attr("year").try_cast("int").alias("year"),
        attr("sr.no", "sop.no", "act.no", "bill.no").alias("number"), attr("act.type", "sr.type", "bill.type").alias("subtype"),
        *(safe_date(attr(v)).alias(k) for k, v in dates.items()),
        attr("terminated").alias("terminated"), F.coalesce(attr("terminated") == "repealed", F.lit(False)).alias("repealed"), F.coalesce(attr("in.amend") != "false", F.lit(True)).alias("in_amend"),
        F.coalesce(attr("imperial") == "yes", F.lit(False)).alias("imperial"), attr("stage").alias("stage"), attr("pco.suffix").alias("pco_suffix"), attr("raised.by").alias("raised_by"),
        attr("official").alias("official"), attr("instructing.office").alias("instructing_office"), F.col("r.attributes").alias("attributes"),
    )


#: The document types that a feed's links may name.
FEED_TYPES = ["act", "regulation", "bill", "sop"]


def feed_entries(feeds: DataFrame, xml_col: str) -> DataFrame:
    """(path, updated, title) of the entries of Atom feeds whose link names a document type."""
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("updated", T.StringType()), T.StructField("title", T.StringType())])))
    def entries(xml: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            try:
                root = ET.fromstring(x) if x else None
            except ET.ParseError:
                root = None
            out = []
            for e in root.iter() if root is not None else []:
                if e.tag.rpartition("}")[2] == "entry":
                    own = {c.tag.rpartition("}")[2]: c for c in e}
                    out.append({"href": own["link"].get("href") if "link" in own else None, "updated": own["updated"].text if "updated" in own else None, "title": own["title"].text if "title" in own else None})
            return out

        return pd.Series([one(x) for x in xml])

    rows = feeds.select(F.explode(entries(xml_col)).alias("e"))
    path = F.regexp_extract("e.href", rf"^(?:https?://[^/]+)?/?((?:{'|'.join(FEED_TYPES)})/.*)$", 1)
    return rows.select(path.alias("path"), F.try_to_timestamp("e.updated").alias("updated"), F.col("e.title").alias("title")).filter("path <> ''")


def jsonp(df: DataFrame, text_col: str, schema: str) -> DataFrame:
    """Rows of ``response.docs`` in ``callback(...)`` texts, with the document's name without its ending."""
    inner = F.regexp_extract(text_col, r"(?s)^\s*[\w.$]+\s*\(\s*(.*?)\s*\)\s*;?\s*$", 1)
    body = F.from_json(F.when(inner != "", inner).otherwise(F.col(text_col)), f"response struct<docs: array<{schema}>>")
    out = df.select(F.explode(body["response"]["docs"]).alias("d")).select("d.*")
    return out.withColumn("name", F.regexp_replace("DocumentName", r"\.[^.]*$", "")) if "DocumentName" in out.columns else out


def enriched(rows: DataFrame, metadata: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Left lookup: each field from the metadata, else the row's own."""
    extra = metadata.select(on, *(F.col(f).alias(f"__{f}") for f in fields))
    out = rows.join(extra, on, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"__{f}", f) if f in rows.columns else F.col(f"__{f}"))
    return out.drop(*(f"__{f}" for f in fields))


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, kind): files with their kind by the first bytes."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head.startswith("25504446"), "pdf").when(head.startswith("FFD8"), "jpg").when(head == "89504E47", "png").when(head.startswith("474946"), "gif").when(head.startswith("424D"), "bmp").otherwise("other")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content", kind.alias("kind"))


def data_uri(content: Column, kind: Column) -> Column:
    """A picture as a data URI."""
    return F.concat(F.lit("data:image/"), F.when(kind == "jpg", "jpeg").otherwise(kind), F.lit(";base64,"), F.base64(content))


def pdf_lines(files: DataFrame) -> DataFrame:
    """Lines of PDF files; needs pdfminer, which is not among this package's requirements."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pdfminer") from e
    import io

    def run(batches):
        for batch in batches:
            rows = [(p, i, line) for p, c in zip(batch["path"], batch["content"], strict=True) for i, line in enumerate(extract_text(io.BytesIO(c)).split("\n"))]
            yield pd.DataFrame(rows, columns=["path", "line_no", "text"])

    return files.filter("kind = 'pdf'").select("path", "content").mapInPandas(run, "path string, line_no long, text string")
