"""Text of one export file to records, by format."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from quillon.functions.text import english_score, fold_text, latex_text
from quillon.sources.people import (
    country_of, doc_type, doi_of, int_of, languages, person, person_first_last, reference_commas, reference_prose, split_references, year_of,
)
from quillon.sources.schema import blank


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: by byte-order mark, then UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin1"


def detect(name: str, text: str) -> str:
    """Format by content first, then by extension; csv is the last resort."""
    head = text[:5000]
    if re.search(r"(?m)^PMID- ?\d", head):
        return "tagged4"
    if re.search(r"(?m)^(?:FN|VR|PT) \S", head) and re.search(r"(?m)^(?:AU|TI|PY|PT) ", head) and not re.search(r"(?m)^[^\n]*\t[^\n]*\t", head[:300]):
        return "tagged2"
    if re.search(r"(?m)^TY  - ", head):
        return "ris"
    if re.search(r"(?m)^\s*@\w+\s*[{(]", head):
        return "bibtex"
    return {"ris": "ris", "bib": "bibtex", "nbib": "tagged4", "ciw": "tagged2"}.get(name.rsplit(".", 1)[-1].lower(), "csv")


# delimited ------------------------------------------------------------------------------


def sniff_separator(text: str) -> str:
    """The most frequent of comma, tab and semicolon outside quotes in the first line; ties in that order."""
    line = re.sub(r'"[^"]*"', "", text.split("\n", 1)[0])
    return max(",\t;", key=lambda s: (line.count(s), -",\t;".index(s)))


def parse_delimited(text: str, separator: str | None = None) -> list[list[str]]:
    """RFC 4180 rows; a quote opens a cell only at its start."""
    sep = separator or sniff_separator(text)
    rows, row, cell, i, n = [], [], [], 0, len(text)
    fresh = True
    while i < n:
        c = text[i]
        if fresh and c == '"':
            i += 1
            while i < n:
                j = text.find('"', i)
                if j < 0:
                    cell.append(text[i:])
                    i = n
                elif text[j + 1 : j + 2] == '"':
                    cell.append(text[i : j + 1])
                    i = j + 2
                else:
                    cell.append(text[i:j])
                    i = j + 1
                    break
            fresh = False
            continue
        if c == sep or c in "\r\n":
            row.append("".join(cell))
            cell, fresh = [], True
            if c != sep:
                rows.append(row)
                row = []
                if c == "\r" and text[i + 1 : i + 2] == "\n":
                    i += 1
        else:
            cell.append(c)
            fresh = False
        i += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return [r for r in rows if any(x.strip() for x in r)]


# fixed values: column names of general tables, English and Spanish
HEADERS = {
    "title": "title|article title|document title|titulo", "authors": "authors|author|author full names|autores|autor", "year": "year|publication year|ano|fecha|date", "source": "source title|source|journal|journal/book|revista|fuente",
    "abstract": "abstract|resumen", "doi": "doi", "authorKeywords": "author keywords|keywords|palabras clave", "indexKeywords": "index keywords|keywords plus|mesh terms", "timesCited": "cited by|times cited|citations|citas|citado por",
    "docTypeRaw": "document type|type|tipo de documento|tipo", "languages": "language of original document|language|idioma", "affiliations": "affiliations|addresses|afiliaciones", "references": "references|cited references|referencias",
    "volume": "volume|volumen", "issue": "issue|numero", "pages": "pages|paginas", "publisher": "publisher|editorial", "issn": "issn", "isbn": "isbn", "originId": "eid|pmid|id|ut", "correspondence": "correspondence address", "url": "link|url",
    "funding": "funding details|funding text", "areas": "research areas|areas", "openAccess": "open access", "sourceAbbrev": "abbreviated source title", "authorAffiliations": "authors with affiliations",
}
_HEADERS = {alias: name for name, aliases in HEADERS.items() for alias in aliases.split("|")}


def _list(text: str, by: str = ";") -> list[str]:
    out = {}
    for p in text.split(by) if text else ():
        if x := " ".join(p.split()):
            out.setdefault(fold_text(x), x)
    return list(out.values())


def read_csv(text: str) -> list[dict]:
    rows = parse_delimited(text)
    at = header_row(rows)
    return [] if at is None else list(map(table_reader(rows[at]), rows[at + 1 :]))


def header_row(rows: list[list[str]]) -> int | None:
    """The first of six rows with two cells or more that are not blank."""
    return next((i for i, r in enumerate(rows[:6]) if sum(bool(x.strip()) for x in r) >= 2), None)


def table_reader(header: list[str]) -> Callable[[list[str]], dict]:
    """What makes a record of a row, by the column names of its table."""
    head = [fold_text(x.strip().lstrip("\ufeff")) for x in header]
    if len({"pt", "au", "ti", "so", "py"} & set(head)) >= 4:
        return lambda r: _tagged2_record({k.upper(): v for k, v in zip(head, r, strict=False)}, tabbed=True)
    if {"pmid", "citation"} <= set(head):
        return lambda r: _summary_record(dict(zip(head, r, strict=False)))
    names = [_HEADERS.get(h, "") for h in head]
    index_a = "eid" in head and "source title" in head
    return lambda r: _table_record(dict(zip(names, r, strict=False)), index_a)


def _summary_record(c: dict) -> dict:
    """A row of a biomedical summary table: volume, issue and pages stand in its citation, as ';12(3):4-5'."""
    get = lambda k: " ".join(c.get(k, "").split())
    cited = get("citation")
    where = re.search(r";(?P<volume>\d+[A-Za-z]?)(?:\((?P<issue>[^)]+)\))?:(?P<pages>[\w-]+)", cited)
    place = {k: v or "" for k, v in where.groupdict().items()} if where else {}
    return blank(
        title=get("title"), authors=[person(x) for x in get("authors").rstrip(".").split(", ") if x], year=int_of(get("publication year")) or year_of(cited), source=get("journal/book"), sourceAbbrev=get("journal/book"),
        doi=doi_of(get("doi")) or doi_of(cited), originId=get("pmid"), docTypeRaw="Journal Article", origin="biomed", **place,
    )


def _table_record(c: dict, index_a: bool) -> dict:
    get = lambda k: " ".join(v.split()) if (v := c.get(k)) else ""
    cited = int_of(c.get("timesCited"))
    authors = [person(x) for x in re.split(r";\s*", get("authors")) if x.strip()] if ";" in get("authors") else [person(x) for x in _names(get("authors"))]
    affiliations = _list(c.get("affiliations", ""))
    for a, chunk in zip(authors, re.split(r";\s*", get("authorAffiliations")), strict=False):
        own = chunk[len(a["full"]) :].strip(" ,") if chunk.startswith(a["full"]) else chunk.split(",", 2)[-1].strip()
        known = [k for k in affiliations if k in own]
        a["affiliations"] = known or ([own] if own else [])
        a["country"] = country_of(own)
    corr = get("correspondence")
    refs = [reference_prose(x) for x in split_references(c.get("references", ""))]
    year = int_of(c.get("year")) if re.fullmatch(r"\s*\d{4}\s*", c.get("year", "")) else year_of(c.get("year"))
    access = get("openAccess")
    return blank(
        title=get("title"), abstract=get("abstract"), source=get("source"), sourceAbbrev=get("sourceAbbrev"), volume=get("volume"), issue=get("issue"), pages=get("pages").replace("–", "-"), doi=doi_of(get("doi")), publisher=get("publisher"),
        docTypeRaw=get("docTypeRaw"), year=year if year and 1500 <= year <= 2100 else None, timesCited=0 if index_a and cited is None else cited, authorKeywords=_list(c.get("authorKeywords", "")), indexKeywords=_list(c.get("indexKeywords", "")),
        areas=_list(c.get("areas", "")), affiliations=affiliations, languages=languages(c.get("languages", "")), issn=_list(c.get("issn", "")), isbn=_list(c.get("isbn", "")), authors=authors, references=refs, correspondence=corr,
        correspondingCountry=country_of(re.split(r";\s*email", corr, flags=re.I)[0]), originId=get("originId"), url=get("url"), funding=get("funding"), openAccess=True if access else None, origin="index-a" if index_a else "table",
    )


def _names(text: str) -> list[str]:
    """Names without semicolons: 'Last F., Last G.' or one name."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if len(parts) > 1 and all(re.fullmatch(r"(?:[A-Z]\.?[\s-]?)+", p) for p in parts[1::2]):
        return [", ".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts


# two-letter tags ------------------------------------------------------------------------

# fixed values: tags that hold one value a line
MULTI2 = set("AU AF C1 C3 CR DE ID SC WC EM RI OI BA BF BE".split())


def read_tagged2(text: str) -> list[dict]:
    """PT ... ER blocks; a line that starts with blanks goes on with the tag before."""
    out, now, tag = [], {}, ""
    for line in text.splitlines():
        head = line[:2]
        if head == "ER":
            if now:
                out.append(_tagged2_record(now))
            now, tag = {}, ""
        elif head == "EF":  # exports that were put together go on
            tag = ""
        elif re.match(r"[A-Z][A-Z0-9](?: |$)", line):
            tag = head
            if tag not in ("FN", "VR"):
                now.setdefault(tag, []).append(line[3:].strip())
        elif line.strip() and tag and tag not in ("FN", "VR"):
            now.setdefault(tag, []).append(line.strip())
    if now:
        out.append(_tagged2_record(now))
    return out


def _tagged2_record(c: dict, tabbed: bool = False) -> dict:
    value = lambda k: " ".join(c[k].split() if isinstance(c.get(k), str) else " ".join(c.get(k, [])).split()) if c.get(k) else ""

    def items(k: str) -> list[str]:
        v = c.get(k)
        if not v:
            return []
        if isinstance(v, str):  # a semicolon inside [...] does not separate
            return [x.strip() for x in re.split(r";(?![^\[]*\])", v) if x.strip()]
        return [x for x in v if x] if k in MULTI2 - {"DE", "ID", "SC", "WC"} else _list(" ".join(v))

    authors = [person(x) for x in (items("AF") or items("AU"))]
    for a, short in zip(authors, items("AU"), strict=False):
        a["initials"] = a["initials"] or person(short)["initials"]
    affiliations = []
    for line in items("C1"):
        m = re.match(r"\[([^\]]*)\]\s*(.*)", line)
        address = (m[2] if m else line).rstrip(".")
        affiliations.append(address)
        for a in authors:
            if m and any(fold_text(n.strip()) in (fold_text(a["full"]), fold_text(a["short"])) for n in m[1].split(";")):
                a["affiliations"] = [*a["affiliations"], address]
                a["country"] = a["country"] or country_of(address)
    pages = f"{value('BP')}-{value('EP')}".strip("-") or value("AR")
    corr = value("RP")
    return blank(
        title=value("TI"), abstract=value("AB"), source=value("SO"), sourceAbbrev=value("J9") or value("JI"), volume=value("VL"), issue=value("IS"), pages=pages, doi=doi_of(value("DI")), publisher=value("PU"), docTypeRaw=value("DT"), year=year_of(value("PY")),
        timesCited=int_of(value("TC")), authorKeywords=_list("; ".join(items("DE"))), indexKeywords=_list("; ".join(items("ID"))), areas=_list("; ".join(items("SC") or items("WC"))), affiliations=affiliations, languages=languages(value("LA")),
        issn=[x for x in (value("SN"), value("EI")) if x], isbn=_list(value("BN")), authors=authors, references=[reference_commas(x) for x in items("CR")], correspondence=corr, correspondingCountry=country_of(corr.split(";")[0]), originId=value("UT"),
        funding=value("FX") or value("FU"), openAccess=True if value("OA") else None, origin="index-b",
    )


# four-letter tags -----------------------------------------------------------------------


def read_tagged4(text: str) -> list[dict]:
    """'TAG - value' blocks that begin with PMID; AD belongs to the last author."""
    out = []
    for block in re.split(r"(?m)^(?=PMID- )", text):
        fields: list[tuple[str, str]] = []
        for line in block.splitlines():
            if m := re.match(r"([A-Z]{2,4}) *- ?(.*)", line):
                fields.append((m[1], m[2].strip()))
            elif line.startswith("      ") and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        if not fields:
            continue
        first = lambda *tags: next((v for t in tags for k, v in fields if k == t), "")  # noqa: B023, E731
        every = lambda t: [v for k, v in fields if k == t]  # noqa: B023, E731
        authors: list[dict] = []
        full = any(k == "FAU" for k, _ in fields)
        for k, v in fields:
            if k == ("FAU" if full else "AU"):
                authors.append(person(v))
            elif k == "AU" and authors and not authors[-1]["initials"]:
                authors[-1]["initials"] = person(v)["initials"]
            elif k == "AUID" and authors and "ORCID" in v.upper():
                authors[-1]["orcid"] = v.split(":")[-1].strip()
            elif k == "AD" and authors and v:
                authors[-1]["affiliations"] = [*authors[-1]["affiliations"], v]
                authors[-1]["country"] = authors[-1]["country"] or country_of(v)
        doi = next((doi_of(v) for k, v in fields if k in ("LID", "AID") and "[doi]" in v), "")
        out.append(
            blank(
                title=first("TI", "BTI").rstrip("."), abstract=first("AB"), source=first("JT", "TA"), sourceAbbrev=first("TA"), volume=first("VI"), issue=first("IP"), pages=first("PG"), doi=doi, docTypeRaw="; ".join(every("PT")), year=year_of(first("DP")),
                authorKeywords=_list("; ".join(every("OT"))), indexKeywords=_list("; ".join(v.split("/")[0].strip("*") for v in every("MH"))), languages=languages(";".join(every("LA"))), issn=[v.split(" ")[0] for v in every("IS")], authors=authors,
                affiliations=_list("|".join(x for a in authors for x in a["affiliations"]), "|"), originId=first("PMID"), origin="biomedical",
            )
        )
    return out


# RIS ------------------------------------------------------------------------------------


def read_ris(text: str) -> list[dict]:
    blocks, now = [], []
    for line in text.splitlines():
        if m := re.match(r"([A-Z][A-Z0-9])  - ?(.*)", line.lstrip("﻿")):
            if m[1] == "ER":
                blocks.append(now)
                now = []
            else:
                now.append((m[1], m[2].strip()))
        elif line.strip() and now:
            now[-1] = (now[-1][0], f"{now[-1][1]} {line.strip()}")
    if now:
        blocks.append(now)
    noted = sum(any(k == "N1" and "Cited By" in v for k, v in b) for b in blocks)
    index_a = bool(blocks) and 2 * noted >= len(blocks)
    return [_ris_record(b, index_a) for b in blocks if b]


def _ris_record(b: list[tuple[str, str]], index_a: bool) -> dict:
    first = lambda *tags: next((v for t in tags for k, v in b if k == t and v), "")
    every = lambda *tags: [v for k, v in b if k in tags and v]
    notes = " ; ".join(every("N1"))
    cited = int_of(m[1]) if (m := re.search(r"Cited By:?\s*(\d+)", notes)) else (0 if index_a else None)
    refs = re.search(r"References:\s*(.*)", notes)
    abstracts = every("AB", "N2")
    pages = f"{first('SP')}-{first('EP')}".strip("-")
    corr = m[1].strip() if (m := re.search(r"Correspondence Address:\s*([^;]*(?:;[^;:]*)*)", notes)) else ""
    return blank(
        title=first("TI", "T1"), abstract=max(abstracts, key=english_score, default=""), source=first("T2", "JO", "JF", "JA"), sourceAbbrev=first("J2", "JA"), volume=first("VL"), issue=first("IS"), pages=pages, doi=doi_of(first("DO")),
        publisher=first("PB"), docTypeRaw=first("M3") or first("TY"), year=year_of(first("PY", "Y1", "DA")), timesCited=cited, authorKeywords=_list(";".join(every("KW"))), affiliations=_list("|".join(every("AD")), "|"), languages=languages(first("LA")),
        issn=every("SN"), authors=[person(x) for x in every("AU", "A1")], references=[reference_prose(x) for x in split_references(refs[1])] if refs else [], correspondence=corr, correspondingCountry=country_of(corr), url=first("UR"),
        origin="index-a" if index_a else "ris",
    )


# BibTeX ---------------------------------------------------------------------------------

_MONTHS = {m: str(i + 1) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def bibtex_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) with @string macros, # concatenation, braces, quotes; comments and preambles are skipped."""
    macros, out, i, n = dict(_MONTHS), [], 0, len(text)

    def value(i: int) -> tuple[str, int]:
        parts = []
        while i < n:
            while i < n and text[i].isspace():
                i += 1
            if i < n and text[i] in '{"':
                closing, depth, j = ("}" if text[i] == "{" else '"'), 0, i + 1
                while j < n and not (text[j] == closing and depth == 0):
                    depth += {"{": 1, "}": -1}.get(text[j], 0) if text[j - 1] != "\\" else 0
                    j += 1
                parts.append(text[i + 1 : j])
                i = j + 1
            else:
                m = re.compile(r"[^\s,#{}()]+").match(text, i)
                if not m:
                    break
                parts.append(macros.get(m[0].lower(), m[0]))
                i = m.end()
            while i < n and text[i].isspace():
                i += 1
            if i < n and text[i] == "#":
                i += 1
                continue
            break
        return "".join(parts), i

    while (at := text.find("@", i)) >= 0:
        m = re.compile(r"@\s*(\w+)\s*([{(])").match(text, at)
        if not m:
            i = at + 1
            continue
        kind, close, i = m[1].lower(), "}" if m[2] == "{" else ")", m.end()
        if kind in ("comment", "preamble"):
            depth = 1
            while i < n and depth:
                depth += (text[i] == m[2]) - (text[i] == close)
                i += 1
            continue
        key = ""
        if kind != "string":
            j = min(x for x in (text.find(",", i), text.find(close, i), n) if x >= 0)
            key, i = text[i:j].strip(), j + (text[j : j + 1] == ",")
        fields: dict[str, str] = {}
        while i < n:
            f = re.compile(r"\s*,?\s*([^\s=,{}()]+)\s*=\s*").match(text, i)
            if not f:
                break
            v, i = value(f.end())
            fields[f[1].lower()] = v
        end = text.find(close, i)
        nxt = text.find("@", i)
        i = end + 1 if end >= 0 and (nxt < 0 or end < nxt) else max(i, nxt if nxt >= 0 else n)
        if kind == "string":
            macros |= {k.lower(): v for k, v in fields.items()}
        else:
            out.append((kind, key, fields))
    return out


def read_bibtex(text: str) -> list[dict]:
    entries = bibtex_entries(text)
    votes = Counter("index-a" if "author_keywords" in f or "scopus" in f.get("source", "").lower() else "index-b" if "unique-id" in f or "keywords-plus" in f else "bibtex" for _, _, f in entries)
    dialect = votes.most_common(1)[0][0] if votes else "bibtex"
    return [_bibtex_record(kind, key, f, dialect) for kind, key, f in entries]


def _bibtex_record(kind: str, key: str, f: dict[str, str], dialect: str) -> dict:
    get = lambda *names: next((latex_text(f[x]) for x in names if f.get(x)), "")
    authors = []
    for x in re.split(r"\s+and\s+", f.get("author", "").replace("\n", " ")):
        if x.strip():
            corporate = re.fullmatch(r"\s*\{(.*)\}\s*", x, re.S)
            authors.append({**person(""), "full": latex_text(corporate[1]), "last": latex_text(corporate[1]), "short": latex_text(corporate[1])} if corporate else person(latex_text(x)))
    cited = int_of(m[1]) if (m := re.search(r"cited by:?\s*(\d+)", get("note").lower())) else int_of(get("times-cited"))
    refs = f.get("references", "") or ""
    own = f.get("cited-references", "")
    affiliations = _list(get("affiliations", "affiliation"), ";" if dialect == "index-a" else "|")
    corr = get("correspondence_address")
    return blank(
        title=get("title"), abstract=get("abstract"), source=get("journal", "booktitle", "series"), sourceAbbrev=get("abbrev_source_title", "journal-iso"), volume=get("volume"), issue=get("number"), pages=re.sub(r"\s*[-–—]+\s*", "-", get("pages")), doi=doi_of(get("doi")),
        publisher=get("publisher"), docTypeRaw=get("document_type", "type") or kind, year=year_of(get("year", "date")), timesCited=0 if dialect == "index-a" and cited is None else cited, authorKeywords=_list(get("author_keywords", "keywords")),
        indexKeywords=_list(get("keywords") if f.get("author_keywords") else get("keywords-plus")), affiliations=affiliations, languages=languages(get("language")), issn=_list(get("issn")), isbn=_list(get("isbn")), authors=authors,
        references=[reference_prose(x) for x in split_references(latex_text(refs))] or [reference_commas(x.strip()) for x in own.splitlines() if x.strip()], correspondence=corr, correspondingCountry=country_of(corr), originId=get("unique-id") or key, url=get("url"), origin=dialect,
    )


READERS = {"csv": read_csv, "tagged2": read_tagged2, "tagged4": read_tagged4, "ris": read_ris, "bibtex": read_bibtex}


def finish(r: dict) -> dict:
    """Trims, derives document type and countries."""
    r = {k: " ".join(v.split()) if v and isinstance(v, str) else v for k, v in r.items()}
    r["docType"] = doc_type(*r["docTypeRaw"].split(";"))
    for a in r["authors"]:
        a["country"] = a["country"] or next((c for x in a["affiliations"] if (c := country_of(x))), "")
    own = [a["country"] for a in r["authors"]] + [country_of(x) for x in r["affiliations"]]
    r["countries"] = list(dict.fromkeys(c for c in [*r["countries"], *own] if c))
    return r


def parse_text(name: str, text: str) -> tuple[str, list[dict], int]:
    """Format, finished records, and how many had no title and were dropped."""
    form = detect(name, text)
    found = [finish(r) for r in READERS[form](text)]
    kept = [r for r in found if r["title"]]
    return form, kept, len(found) - len(kept)


__all__ = ["READERS", "decode", "detect", "finish", "header_row", "parse_delimited", "parse_text", "person_first_last", "sniff_separator", "table_reader"]
