"""ZIP containers as tables: a row for each member."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBERS = "work string, ord long, path string, stored boolean, body binary"


def members(packages: DataFrame) -> DataFrame:
    """work, ord, path, stored, body of every member of (work, content); a container that can't be read has none."""

    def run(batches):
        for batch in batches:
            for work, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        rows = [(work, i, x.filename, x.compress_type == zipfile.ZIP_STORED, z.read(x)) for i, x in enumerate(z.infolist(), 1) if not x.is_dir()]
                except zipfile.BadZipFile:
                    pass
                kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["work", "ord", "path", "stored", "body"])

    return packages.select(F.col("work").cast("string"), "content").mapInArrow(run, MEMBERS)


def spine(packages: DataFrame) -> DataFrame:
    """work, place, path, linear: the documents of each package's spine, by XPath over its package file."""
    m = members(packages)
    opf = m.where("path like '%.opf'").select("work", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_replace(F.decode("body", "UTF-8"), r"\sxmlns(?::\w+)?=\"[^\"]*\"", "").alias("xml"))
    refs = F.arrays_zip(F.xpath("xml", F.lit("//spine/itemref/@idref")).alias("idref"), F.transform(F.xpath("xml", F.lit("//spine/itemref")), lambda x: x).alias("x"))
    items = F.map_from_arrays(F.xpath("xml", F.lit("//manifest/item/@id")), F.xpath("xml", F.lit("//manifest/item/@href")))
    return opf.select("work", "folder", items.alias("items"), F.posexplode(refs).alias("at", "r")).select("work", (F.col("at") + 1).cast("long").alias("place"), F.concat("folder", F.try_element_at("items", F.col("r.idref"))).alias("path"))
