"""Reading export files: one row per record, whatever the format."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.sources.parsers import decode, detect, finish, header_row, parse_delimited, parse_text, sniff_separator, table_reader
from quillon.sources.scan import scan_tagged
from quillon.sources.schema import RECORD, blank

#: Bytes of the largest file that a task reads whole.
LARGE = 8 << 20
#: Rows of a large table that become records at once.
CHUNK = 2000
#: Bytes of a large file by which its format is told.
_HEAD = 1 << 16


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = to_arrow_schema(RECORD)
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            file = path.rsplit("/", 1)[-1]
            try:
                text, encoding = decode(bytes(content))
                form, rows, dropped = parse_text(file, text)
                for i, r in enumerate(rows):
                    r.update(path=path, file=file, position=i, format=form, warning="")
                if dropped:
                    rows.append(blank(path=path, file=file, format=form, warning=f"dropped:{dropped}"))
                if not rows:
                    rows = [blank(path=path, file=file, format=form, warning="empty")]
            except Exception as e:  # a bad file is a row of its own, it does not stop the job
                rows = [blank(path=path, file=file, warning=f"readError:{type(e).__name__}")]
            yield _batch(rows)


def read_bib(spark: SparkSession, path: str, skip_repeated: bool = False) -> DataFrame:
    """Records of all files under ``path`` (folders and globs too), one task per files; rows with a warning have no record.

    Tables of over ``LARGE`` bytes are read row by row, and tagged exports in UTF-8 record by record (``scan_tagged``), so
    that a task never holds one whole; BibTeX, and tagged exports in other encodings, are still read whole.
    ``skip_repeated``: of files of the same name and size only the first path is read.
    """
    files = spark.read.format("binaryFile").load(path)
    if skip_repeated:
        files = files.join(repeated_files(spark, path).select("path"), "path", "left_anti")
    large = [r["path"] for r in files.where(F.col("length") > LARGE).select("path").collect()]  # contents are not read
    tables, tagged = _layouts(spark, large) if large else ({}, {})
    apart = [x for paths in tables.values() for x, _ in paths] + [x for paths in tagged.values() for x in paths]
    whole = files
    if apart:  # a condition on the length alone, so that contents of other files are not read
        whole = files.where(F.col("length") <= LARGE)
        if rest := [x for x in large if x not in set(apart)]:
            whole = whole.unionByName(spark.read.format("binaryFile").load([_literal(x) for x in rest]))
    found = whole.select("path", "content").mapInArrow(lambda batches: _parse(b.to_pandas() for b in batches), RECORD)
    for (encoding, separator), paths in tables.items():
        found = found.unionByName(_read_tables(spark, [x for x, _ in paths], max(n for _, n in paths), encoding, separator))
    for form, paths in tagged.items():
        found = found.unionByName(scan_tagged(spark, [_literal(x) for x in paths], form).withColumn("path", F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))))
    return found


def _literal(path: str) -> str:
    """A path whose odd characters are no glob."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", path)


def _head(spark: SparkSession, path: str, length: int) -> bytes:
    """The whole lines among the first bytes of a file; more bytes if the first line is longer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for size in (_HEAD, 16 * _HEAD):
        stream = files.open(where)
        try:
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(length, size)))
        finally:
            stream.close()
        if length <= size:
            return data
        if (end := data.rfind(b"\n")) >= 0:
            return data[: end + 1]
    return data


def _layouts(spark: SparkSession, large: list[str]) -> tuple[dict[tuple[str, str], list[tuple[str, int]]], dict[str, list[str]]]:
    """By encoding and separator the tables among large files with their columns, and by format the tagged ones in UTF-8; from their first lines."""
    paths = [_literal(x) for x in large]
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("_metadata.file_path").alias("url")).collect()
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("url"), "value")
    sound = {r["url"]: r["ok"] for r in lines.groupBy("url").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).collect()}
    tables, tagged = defaultdict(list), defaultdict(list)
    for path, length, url in files:
        data = _head(spark, path, length)
        if data.startswith((b"\xff\xfe", b"\xfe\xff")):
            text, encoding = decode(data)
        else:
            encoding = "utf-8" if sound.get(url) else "latin1"
            text = data.decode(encoding, "replace")
        form, text = detect(path.rsplit("/", 1)[-1], text), text.removeprefix("\ufeff")
        if form in ("tagged2", "tagged4", "ris") and encoding == "utf-8":
            tagged[form].append(path)
        elif form == "csv" and header_row(rows := parse_delimited(text)[:6]) is not None:
            tables[encoding, sniff_separator(text)].append((path, max(map(len, rows))))
    return tables, tagged


def _read_tables(spark: SparkSession, paths: list[str], width: int, encoding: str, separator: str) -> DataFrame:
    """Records of delimited files, each read by one task from its start to its end, row by row."""
    names = [f"c{i}" for i in range(width)]
    charset = {"utf-8": "UTF-8", "latin1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}[encoding]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).options(header=False, multiLine=True, sep=separator, quote='"', escape='"', encoding=charset).csv([_literal(x) for x in paths])
    url = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return rows.select(F.url_decode(url).alias("path"), F.array(*names).alias("cells")).mapInArrow(_parse_rows, RECORD)


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tables in their order; a task has whole files, one after the other."""
    path, first, read, position, dropped = None, [], None, 0, 0

    def ended() -> list[dict]:
        own = {"path": path, "file": path.rsplit("/", 1)[-1], "format": "csv"}
        return ([blank(**own, warning=f"dropped:{dropped}")] if dropped else []) + ([blank(**own, warning="empty")] if not dropped and not position else [])

    out: list[dict] = []
    for batch in batches:
        for here, cells in zip(batch["path"].to_pylist(), batch["cells"].to_pylist(), strict=True):
            if here != path:
                if path is not None:
                    out += ended()
                path, first, read, position, dropped = here, [], None, 0, 0
            row = ["" if x is None else x for x in cells]
            if not any(x.strip() for x in row):
                continue
            if read is None:
                if len(first) < 6:  # else no header: no records
                    first.append(row)
                    if header_row(first) is not None:
                        read = table_reader(row)
                continue
            r = finish(read(row))
            if r["title"]:
                r.update(path=path, file=path.rsplit("/", 1)[-1], position=position, format="csv", warning="")
                out.append(r)
                position += 1
            else:
                dropped += 1
            if len(out) >= CHUNK:
                yield _batch(out)
                out = []
    if path is not None:
        yield _batch(out + ended())


def repeated_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, first): files that have the name and size of a file with a smaller path; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring_index("path", "/", -1).alias("file"))
    first = files.groupBy("file", "length").agg(F.min("path").alias("first"))
    return files.join(first, ["file", "length"]).where("path != first").select("path", "first")


def records_only(rows: DataFrame) -> DataFrame:
    return rows.where("warning = ''")


def file_catalogue(rows: DataFrame) -> DataFrame:
    """Per file: format, records, warnings."""
    return rows.groupBy("file").agg(
        F.max("format").alias("format"), F.count_if(F.col("warning") == "").alias("records"), F.array_sort(F.collect_set(F.nullif("warning", F.lit("")))).alias("warnings")
    )


def with_ids(rows: DataFrame) -> DataFrame:
    """rec = a hash of the file's whole path and the place in it: the same on every run."""
    return rows.withColumn("rec", F.xxhash64("path", "position"))


FIELDS = ["title", "abstract", "authors", "year", "source", "doi", "authorKeywords", "affiliations", "references", "timesCited", "languages"]


def completeness(rows: DataFrame) -> DataFrame:
    """(field, filled, share) over the records."""
    kinds = dict(rows.dtypes)
    filled = lambda c: (F.size(c) > 0) if kinds[c].startswith("array") else (F.col(c).cast("string") != "")
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(filled(c), F.lit(False))).alias(c) for c in FIELDS])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in FIELDS])).alias("x")).select(
        "x.field", "x.filled", (F.col("x.filled") / F.when(F.col("n") > 0, F.col("n"))).alias("share")
    )


def import_warnings(rows: DataFrame) -> DataFrame:
    """(file, code, value): what the records of a file lack; value is a percentage, or for noYear the records."""
    has = lambda c: F.size(c) > 0
    share = {
        "references": has("references"), "abstract": F.coalesce(F.col("abstract"), F.lit("")) != "", "keywords": has("authorKeywords") | has("indexKeywords"), "affiliations": has("affiliations"), "countries": has("countries"),
        "cited": F.col("timesCited").isNotNull(), "doi": F.coalesce(F.col("doi"), F.lit("")) != "",
    }
    one = records_only(rows).groupBy("file").agg(F.count_if(F.col("year").isNull()).alias("undated"), *[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in share.items()])
    percent = lambda c: F.round(100 * F.col(c)).cast("long")
    none = F.lit(0).cast("long")
    codes = [
        ("noReferences", F.col("references") == 0, none), ("fewReferences", (F.col("references") > 0) & (F.col("references") < 0.5), percent("references")), ("noAbstract", F.col("abstract") == 0, none), ("noKeywords", F.col("keywords") == 0, none),
        ("noAffiliations", F.col("affiliations") == 0, none), ("fewCountries", (F.col("affiliations") > 0) & (F.col("countries") < 0.5), percent("countries")), ("noCitations", F.col("cited") == 0, none), ("fewDoi", F.col("doi") < 0.5, percent("doi")),
        ("noYear", F.col("undated") > 0, F.col("undated")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), value.alias("value"))) for code, test, value in codes]))
    return one.select("file", F.explode(found).alias("w")).select("file", "w.code", "w.value")
