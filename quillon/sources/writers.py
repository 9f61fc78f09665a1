"""Sinks: delimited tables, BibTeX, network files, bundles, projects."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import fold


def flat(df: DataFrame) -> DataFrame:
    """Lists joined with '; ', missing values and NaN blank."""
    out = []
    for c, t in df.dtypes:
        x = F.col(c)
        if t.startswith("array<struct"):
            x = F.array_join(F.transform(x, lambda s: F.coalesce(s[0], F.lit(""))), "; ")
        elif t.startswith("array"):
            x = F.array_join(x.cast("array<string>"), "; ")
        elif t in ("double", "float"):
            x = F.when(~F.isnan(x), x)
        out.append(F.coalesce(x.cast("string"), F.lit("")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with CRLF and doubled quotes; any size."""
    flat(df).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def csv_text(df: DataFrame) -> str:
    """One CSV text with a byte-order mark, for a table that fits the driver (a report)."""
    return "﻿" + flat(df).toPandas().to_csv(index=False, lineterminator="\r\n")


_LATEX = [("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]


def latex_escape(c):
    """Special characters of LaTeX in one pass, so that no escape is escaped again."""
    marked = F.translate(c, "".join(a for a, _ in _LATEX), "".join(chr(0xE000 + i) for i in range(len(_LATEX))))
    for i, (_, b) in enumerate(_LATEX):
        marked = F.replace(marked, F.lit(chr(0xE000 + i)), F.lit(b))
    return marked


def bibtex(records: DataFrame, position: str = "rec") -> DataFrame:
    """(rec, value): entries with keys surname + year + first word of four letters; equal keys get a, b, ... in order."""
    surname = F.regexp_replace(fold(F.coalesce(F.get("authors", F.lit(0))["last"], F.lit("anon"))), "[^a-z]+", "")
    word = F.regexp_extract(fold(F.col("title")), r"(?:^|[^a-z])([a-z]{4,})", 1)
    base = F.concat(surname, F.coalesce(F.col("year").cast("string"), F.lit("")), word)
    rows = records.withColumn("_key", base)
    w = Window.partitionBy("_key")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(position))
    letters = F.when(i <= 26, F.chr(i + 96)).otherwise(F.concat(F.chr(F.floor((i - 1) / 26).cast("int") + 96), F.chr((i - 1) % 26 + 97)))
    kinds = {"article": "article", "review": "article", "conference paper": "inproceedings", "book": "book", "book chapter": "incollection", "thesis": "phdthesis"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("docType")), F.lit("misc"))
    rows = rows.withColumn("_key", F.when(n > 1, F.concat("_key", letters)).otherwise(F.col("_key")))
    field = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), latex_escape(c.cast("string")), F.lit("}")))
    authors = F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", F.nullif(a["last"], F.lit("")), F.nullif(a["first"], F.lit("")))), " and ")
    parts = [
        field("author", authors), field("title", F.col("title")), field("journal", F.col("source")), field("year", F.col("year")), field("volume", F.col("volume")), field("number", F.col("issue")), field("pages", F.col("pages")),
        field("doi", F.col("doi")), field("keywords", F.array_join("authorKeywords", "; ")), field("abstract", F.col("abstract")), field("publisher", F.col("publisher")), field("issn", F.array_join("issn", "; ")),
    ]
    return rows.select(position, F.concat(F.lit("@"), kind, F.lit("{"), F.col("_key"), F.lit(",\n"), F.array_join(F.array_compact(F.array(*parts)), ",\n"), F.lit("\n}\n")).alias("value"))


def write_bibtex(records: DataFrame, path: str, position: str = "rec") -> None:
    bibtex(records, position).select("value").write.mode("overwrite").text(path)


# networks, bounded by the selection of their nodes ---------------------------------------


def _number(x) -> str:
    return f"{round(float(x), 8):.8f}".rstrip("0").rstrip(".") or "0"


def _sorted(nodes: DataFrame, edges: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    n = nodes.toPandas().sort_values("node", ignore_index=True)
    e = edges.select("src", "dst", "weight").toPandas().sort_values(["src", "dst"], ignore_index=True)
    return n, e


def _measures(n: pd.DataFrame) -> list[str]:
    return [c for c in n.columns if c != "node"]


def graphml(nodes: DataFrame, edges: DataFrame) -> str:
    n, e = _sorted(nodes, edges)
    kind = lambda c: "double" if pd.api.types.is_numeric_dtype(n[c]) else "string"
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>']
    out += [f'<key id={quoteattr(c)} for="node" attr.name={quoteattr(c)} attr.type="{kind(c)}"/>' for c in _measures(n)]
    out += ['<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="undirected">']
    for row in n.to_dict("records"):
        data = "".join(f"<data key={quoteattr(c)}>{_number(row[c]) if kind(c) == 'double' else escape(str(row[c]))}</data>" for c in _measures(n))
        out.append(f"<node id={quoteattr(str(row['node']))}><data key=\"label\">{escape(str(row['node']))}</data>{data}</node>")
    out += [f'<edge source={quoteattr(str(a))} target={quoteattr(str(b))}><data key="weight">{_number(w)}</data></edge>' for a, b, w in e.itertuples(index=False)]
    return "\n".join([*out, "</graph>", "</graphml>", ""])


def gexf(nodes: DataFrame, edges: DataFrame) -> str:
    n, e = _sorted(nodes, edges)
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="undirected">', '<attributes class="node">']
    out += [f'<attribute id="{i}" title={quoteattr(c)} type="{"double" if pd.api.types.is_numeric_dtype(n[c]) else "string"}"/>' for i, c in enumerate(_measures(n))]
    out += ["</attributes>", "<nodes>"]
    for row in n.to_dict("records"):
        values = "".join(f'<attvalue for="{i}" value={quoteattr(_number(row[c]) if pd.api.types.is_numeric_dtype(n[c]) else str(row[c]))}/>' for i, c in enumerate(_measures(n)))
        out.append(f"<node id={quoteattr(str(row['node']))} label={quoteattr(str(row['node']))}><attvalues>{values}</attvalues></node>")
    out += ["</nodes>", "<edges>"]
    out += [f'<edge id="{i}" source={quoteattr(str(a))} target={quoteattr(str(b))} weight="{_number(w)}"/>' for i, (a, b, w) in enumerate(e.itertuples(index=False))]
    return "\n".join([*out, "</edges>", "</graph>", "</gexf>", ""])


def pajek(nodes: DataFrame, edges: DataFrame) -> str:
    """The .net format; x and y, if given, are scaled to 0..1."""
    n, e = _sorted(nodes, edges)
    at = {x: i + 1 for i, x in enumerate(n["node"])}
    place = [""] * len(n)
    if {"x", "y"} <= set(n.columns) and len(n):
        scaled = [(n[c] - n[c].min()) / ((n[c].max() - n[c].min()) or 1) for c in ("x", "y")]
        place = [f" {a:.4f} {b:.4f} 0.5" for a, b in zip(*scaled, strict=True)]
    out = [f"*Vertices {len(n)}", *('{} "{}"{}'.format(i + 1, str(x).replace('"', "'"), p) for i, (x, p) in enumerate(zip(n["node"], place, strict=True)))]
    return "\r\n".join([*out, "*Edges", *(f"{at[a]} {at[b]} {_number(w)}" for a, b, w in e.itertuples(index=False)), ""])


def node_table(nodes: DataFrame, edges: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Node and edge tables with ids from 1."""
    n, e = _sorted(nodes, edges)
    at = {x: i + 1 for i, x in enumerate(n["node"])}
    return n.assign(id=n["node"].map(at)), e.assign(source=e["src"].map(at), target=e["dst"].map(at))


def bundle(tables: dict[str, DataFrame], texts: dict[str, str] | None = None) -> bytes:
    """A ZIP of report tables and network files with an index."""
    out = io.BytesIO()
    index = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            file = re.sub(r"[^\w.-]+", "_", name) + ".csv"
            z.writestr(file, csv_text(df))
            index.append((name, file, "table"))
        for name, text in (texts or {}).items():
            z.writestr(name, text)
            index.append((name, name, "text"))
        z.writestr("index.csv", "﻿" + pd.DataFrame(index, columns=["name", "file", "kind"]).to_csv(index=False, lineterminator="\r\n"))
    return out.getvalue()


# projects -------------------------------------------------------------------------------

PROJECT = {"format": "quillon-project", "version": 1}


def save_project(records: DataFrame, settings: dict, path: str) -> None:
    """Records as Parquet and settings as compressed JSON, both by Spark's file systems."""
    records.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records")
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(PROJECT | {"settings": settings}),)], "value string").coalesce(1).write.mode("overwrite").option("compression", "gzip").text(f"{path}/settings")


def load_project(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    head = json.loads("".join(r[0] for r in spark.read.text(f"{path}/settings").collect()))
    if head.get("format") != PROJECT["format"] or head.get("version", 0) > PROJECT["version"]:
        raise ValueError("not a project of this version")
    return spark.read.parquet(f"{path}/records"), head["settings"]


def load_json_project(path: str) -> dict:
    """A plain or gzip JSON snapshot, on the driver."""
    data = Path(path).read_bytes()
    return json.loads(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
