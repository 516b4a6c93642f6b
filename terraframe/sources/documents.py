"""JSON, GeoJSON and CSV: reading and writing the files that jobs exchange and export."""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terraframe import schemas
from terraframe.functions.geometry import from_geojson, to_geojson
from terraframe.operators.components import _delete, _folder
from terraframe.sources import stretches
from terraframe.sources.stretches import store as _store

BOM = "﻿"


def write_text(path: str, parts: Iterable[str]) -> None:
    """One UTF-8 file, replaced whole."""
    store, name = _store(path)
    with store.open_output_stream(name) as out:
        for p in parts:
            out.write(p.encode("utf-8"))


def write_rows(path: str, head: str, lines: DataFrame, tail: str = "", lead: int = 0) -> None:
    """One UTF-8 file of ``head``, the lines of a frame with one text column, in its order, and ``tail``; the first ``lead`` bytes of the lines are left out.

    Tasks write the lines as parts in the shared folder; the driver joins the bytes of the parts and holds a block at a time.
    """
    base = _folder(lines.sparkSession)
    lines.write.option("compression", "none").text(base)
    shared, folder = _store(base)
    parts = sorted(f.path for f in shared.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.startswith("part-"))
    store, name = _store(path)
    with store.open_output_stream(name) as out:
        out.write(head.encode("utf-8"))
        for p in parts:
            with shared.open_input_stream(p) as f:
                lead -= len(f.read(lead)) if lead else 0
                while block := f.read(1 << 22):
                    out.write(block)
        out.write(tail.encode("utf-8"))
    _delete(lines.sparkSession, base)


def _parsed(kind) -> Column:
    """The JSON ``text`` of an element; from a generator, as what follows would be pushed below and parse it again."""
    return F.explode(F.array(F.from_json("text", kind)))


def read_detections(spark: SparkSession, path: str, split: int = stretches.SPLIT) -> tuple[DataFrame, dict]:
    """(records with ``geom``, {crs, transform, bounds, pixel_size}) of a detections document.

    Of a document of more than ``split`` bytes, tasks read stretches; a smaller one is read by one task.
    """
    fields = {f.name: f.dataType for f in StructType.fromDDL(schemas.DETECTIONS_JSON)}
    keys = ["crs", "transform", "bounds", "pixel_size"]
    root = stretches.root(spark, path, split)
    found = root.elements(spark, "kayitlar") if root else None
    if found is not None:
        doc = spark.createDataFrame([(root.text(keys),)], "text string").select(F.from_json("text", StructType([StructField(k, fields[k]) for k in keys])).alias("d")).select("d.*")
        records = found.select(_parsed(fields["kayitlar"].elementType).alias("k"))
    else:
        doc = spark.read.schema(schemas.DETECTIONS_JSON).json(path, multiLine=True)
        records = doc.select(F.explode("kayitlar").alias("k"))
    meta = doc.select(*keys).first()
    rows = records.select("k.id", "k.confidence", "k.alan_m2", "k.cap_m", "k.merkez_x", "k.merkez_y", from_geojson(F.col("k.geometry.coordinates")).alias("geom"))
    return rows, meta.asDict(recursive=True) if meta else {}


def write_detections(df: DataFrame, path: str, crs: str, transform: dict, bounds: dict, pixel_size: float) -> None:
    """The detections document of records with ``geom``, in order of id."""
    import json

    rows = df.select(F.to_json(F.struct("id", "confidence", "alan_m2", "cap_m", "merkez_x", "merkez_y", to_geojson(F.col("geom")).alias("geometry"))).alias("j"), "id").orderBy("id").select("j")
    tail = json.dumps({"crs": crs, "transform": transform, "bounds": bounds, "pixel_size": pixel_size}, ensure_ascii=False)[1:]
    _write_list(path, '{"kayitlar": [', rows, "], " + tail)


def _write_list(path: str, head: str, rows: DataFrame, tail: str) -> None:
    """JSON texts with commas between them: each line begins with one, which the first line loses."""
    write_rows(path, head + "\n", rows.select(F.concat(F.lit(","), F.col(rows.columns[0]))), tail, lead=1)


def features(df: DataFrame, geom: str = "geom", order: str | None = None) -> DataFrame:
    """One GeoJSON feature text ``feature`` for each row, its properties the other columns; nulls are left out."""
    props = [c for c in df.columns if c != geom]
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), to_geojson(F.col(geom)).alias("geometry")))
    return (df.orderBy(order) if order else df).select(text.alias("feature"))


def write_geojson(df: DataFrame, path: str, name: str, crs: str | None = None, geom: str = "geom", order: str | None = "id") -> None:
    """A feature collection in one file."""
    import json

    extra = f', "crs": {json.dumps({"type": "name", "properties": {"name": crs}})}' if crs else ""
    _write_list(path, f'{{"type": "FeatureCollection", "name": {json.dumps(name)}{extra}, "features": [', features(df, geom, order), "]}")


def read_geojson(spark: SparkSession, path: str, properties: str = "", split: int = stretches.SPLIT) -> DataFrame:
    """The polygons of a feature collection with the ``properties`` named by a DDL list.

    Of a document of more than ``split`` bytes, tasks read stretches; a smaller one is read by one task.
    """
    shape = "struct<type:string,coordinates:array<array<array<double>>>>"
    fields = "struct<" + ",".join(f"{n}:{t}" for n, t in (p.split() for p in properties.split(",") if p.strip())) + ">" if properties.strip() else "struct<_none:string>"
    feature = f"struct<properties:{fields},geometry:{shape}>"
    root = stretches.root(spark, path, split)
    found = root.elements(spark, "features") if root else None
    if found is not None:
        f = found.select(F.col("i").cast("int").alias("i"), _parsed(feature).alias("f"))
    else:
        doc = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True)
        f = doc.select(F.posexplode("features").alias("i", "f"))
    cols = [F.col(f"f.properties.{p.split()[0]}") for p in properties.split(",") if p.strip()]
    return f.where("f.geometry is not null").select((F.col("i") + 1).alias("feature_no"), *cols, from_geojson(F.col("f.geometry.coordinates")).alias("geom"))


def shortest(c: Column) -> Column:
    """A number as the shortest text that reads back as itself, without an exponent up to 1e15 and without a bare ".0"; null is empty."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.15f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.coalesce(F.when(text.rlike("E"), plain).otherwise(text), F.lit(""))


def write_csv(df: DataFrame, path: str, order: str | list[str] | None = None, bom: bool = True) -> None:
    """One CSV file with a header, lines ended by \\n, doubles in their shortest form, nulls empty. Always written, if only the header."""
    cols = [shortest(F.col(c)) if t in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    quoted = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cols]
    ordered = df.orderBy(*([order] if isinstance(order, str) else order)) if order else df
    lines = ordered.select(F.concat_ws(",", *quoted).alias("line"))
    write_rows(path, (BOM if bom else "") + ",".join(df.columns) + "\n", lines)


def require(paths: dict[str, str], optional: dict[str, str] | None = None) -> dict[str, bool]:
    """Whether each optional input is there; raises FileNotFoundError that names every other one that is missing."""
    def there(p):
        store, name = _store(p)
        return store.get_file_info(name).type != fs.FileType.NotFound

    missing = [f"{k}: {p}" for k, p in paths.items() if not there(p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + "; ".join(missing))
    return {k: there(p) for k, p in (optional or {}).items()}


def image_counts(spark: SparkSession, splits: dict[str, str], pattern: str = "*.{jpg,jpeg,png,tif,tiff}") -> DataFrame:
    """``split, n, percent`` of the images in each split's folder; whole percents, rounded down. Files are listed, not read."""
    files = lambda name, path: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.lit(name).alias("split"))
    frame = spark.createDataFrame([(s,) for s in splits], "split string")
    rows = None
    for name, path in splits.items():
        rows = files(name, path) if rows is None else rows.unionByName(files(name, path))
    counts = frame.join(rows.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # one row of one figure: an aggregate without keys
    return counts.join(F.broadcast(total)).select("split", "n", F.coalesce(F.floor(F.try_divide(F.col("n") * 100, F.col("total"))), F.lit(0)).cast("int").alias("percent"))
