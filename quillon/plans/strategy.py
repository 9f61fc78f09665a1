"""Search strategies: a title becomes blocks of terms, blocks become boolean strings or a predicate.

A block is a list of alternatives; a strategy is an AND of ORs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import fold, fold_text

# fixed values: a glossary of English synonyms with Spanish forms (concept: alternatives)
GLOSSARY = {
    "machine learning": ["statistical learning", "aprendizaje automatico"], "deep learning": ["deep neural network", "aprendizaje profundo"], "artificial intelligence": ["ai", "inteligencia artificial"], "climate change": ["global warming", "cambio climatico"],
    "higher education": ["university education", "educacion superior"], "teacher": ["educator", "docente", "profesor"], "student": ["pupil", "learner", "estudiante", "alumno"], "health": ["healthcare", "salud"], "mental health": ["psychological wellbeing", "salud mental"],
    "systematic review": ["evidence synthesis", "revision sistematica"], "bibliometric analysis": ["scientometric analysis", "analisis bibliometrico"], "social media": ["social network site", "redes sociales"], "sustainability": ["sustainable development", "sostenibilidad"],
    "renewable energy": ["clean energy", "energia renovable"], "water quality": ["water pollution", "calidad del agua"], "covid-19": ["sars-cov-2", "coronavirus"], "elderly": ["older adult", "aged", "adulto mayor"], "child": ["infant", "nino"], "cancer": ["neoplasm", "tumor", "cancer"],
    "diabetes": ["diabetes mellitus"], "obesity": ["overweight", "obesidad"], "innovation": ["innovacion"], "entrepreneurship": ["emprendimiento"], "gender": ["sex difference", "genero"], "migration": ["immigration", "migracion"], "tourism": ["turismo"], "economy": ["economics", "economia"],
}
STOP = set("a al an analysis and approach as at based by case con con de del el en for from impact in la las los of on para por role study the to un una using with y".split())
SPANISH = set("a al con de del el en la las los para por un una y que".split())

# fixed values: field syntax of the dialects
DIALECTS = {
    "index_a": {"block": "TITLE-ABS-KEY({})", "phrase": '"{}"', "wild": "*", "years": "PUBYEAR > {a1} AND PUBYEAR < {b1}"}, "index_b": {"block": "TS=({})", "phrase": '"{}"', "wild": "*", "years": "PY={a}-{b}"},
    "biomed": {"block": "({})", "phrase": '"{}"[tiab]', "wild": "*", "years": '("{a}"[dp] : "{b}"[dp])'}, "open": {"block": "({})", "phrase": '"{}"', "wild": "", "years": "publication_year:{a}-{b}"}, "scholar": {"block": "({})", "phrase": '"{}"', "wild": "", "years": ""},
    "ieee": {"block": "({})", "phrase": '"{}"', "wild": "*", "years": ""}, "eric": {"block": "({})", "phrase": '"{}"', "wild": "", "years": "pubyearmin:{a} pubyearmax:{b}"}, "dimensions": {"block": "({})", "phrase": '"{}"', "wild": "", "years": "year in [{a}:{b}]"},
}


def stem(word: str) -> str:
    """A key without plural and gender endings (English and Spanish)."""
    w = fold_text(word)
    for end, put in (("ies", "y"), ("ciones", "cion"), ("sses", "ss"), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith(("ss", "is", "us")):
            w = w[: len(w) - len(end)] + put
            break
    return re.sub(r"[ao]$", "", w) if len(w) > 4 else w


def key(phrase: str) -> str:
    return " ".join(stem(w) for w in phrase.split())


def index() -> dict[str, str]:
    """Stemmed form of every term and alternative to its concept."""
    out = {}
    for concept, others in GLOSSARY.items():
        for term in (concept, *others):
            out.setdefault(key(term), concept)
    return out


def tokens(title: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:-[^\W_]+)*", title.lower())


def language(title: str) -> str:
    words = tokens(title)
    return "es" if sum(w in SPANISH for w in words) > sum(w in {"the", "of", "and", "in", "for", "on", "with", "to", "an"} for w in words) else "en"


@dataclass(frozen=True)
class Block:
    terms: tuple[str, ...]
    kind: str = "n"

    def with_terms(self, *more: str) -> Block:
        return Block(unique_terms([*self.terms, *more]), self.kind)


@dataclass(frozen=True)
class Strategy:
    blocks: tuple[Block, ...] = field(default_factory=tuple)
    year_from: int | None = None
    year_to: int | None = None


def unique_terms(terms: list[str]) -> tuple[str, ...]:
    seen, out = set(), []
    for t in terms:
        t = " ".join(t.split())
        if t and key(t) not in seen:
            seen.add(key(t))
            out.append(t)
    return tuple(out)


def concepts(title: str) -> Strategy:
    """Blocks of a title: the longest glossary phrases first, then its other words but stop words."""
    words, known = tokens(title), index()
    blocks, i = [], 0
    while i < len(words):
        for n in range(min(4, len(words) - i), 0, -1):
            phrase = " ".join(words[i : i + n])
            concept = known.get(key(phrase))
            if concept:
                blocks.append(Block(unique_terms([phrase, concept, *GLOSSARY[concept]]), "g"))
                i += n
                break
        else:
            if words[i] not in STOP and len(words[i]) > 2:
                blocks.append(Block((words[i],)))
            i += 1
    return Strategy(tuple(dict.fromkeys(blocks)))


def merge(s: Strategy, a: int, b: int) -> Strategy:
    """Blocks a and b become one."""
    both = Block(unique_terms([*s.blocks[a].terms, *s.blocks[b].terms]), s.blocks[a].kind)
    return Strategy(tuple(both if i == a else x for i, x in enumerate(s.blocks) if i != b), s.year_from, s.year_to)


def separate(s: Strategy, block: int, term: str) -> Strategy:
    """A term of a block becomes a block of its own."""
    rest = Block(tuple(t for t in s.blocks[block].terms if t != term), s.blocks[block].kind)
    blocks = [x for i, x in enumerate(s.blocks) for x in ((rest, Block((term,))) if i == block else (x,)) if x.terms]
    return Strategy(tuple(blocks), s.year_from, s.year_to)


def term(text: str, dialect: str) -> str:
    """A phrase in quotes; a single word with the dialect's wildcard for its plural."""
    d = DIALECTS[dialect]
    if " " in text or "-" in text:
        return d["phrase"].format(text)
    return text + (d["wild"] if len(text) >= 5 else "")


def compile_query(s: Strategy, dialect: str) -> str:
    d = DIALECTS[dialect]
    parts = [d["block"].format(" OR ".join(term(t, dialect) for t in b.terms)) for b in s.blocks if b.terms]
    if d["years"] and s.year_from and s.year_to:
        parts.append(d["years"].format(a=s.year_from, b=s.year_to, a1=s.year_from - 1, b1=s.year_to + 1))
    return " AND ".join(parts)


def predicate(s: Strategy, text: Column, year: Column | None = None) -> Column:
    """The strategy as a condition on loaded records: AND of ORs over the folded text."""
    folded, out = fold(text), F.lit(True)
    for b in s.blocks:
        either = F.lit(False)
        for t in b.terms:
            stemmed = re.sub("(?<=[a-z]{3})s$", "", fold_text(t))
            either = either | folded.rlike(r"\b" + re.escape(stemmed).replace(r"\ ", r"\s+") + (r"\w*" if " " not in t and len(t) >= 5 else r"(?:e?s)?\b"))
        out = out & either
    if year is not None and s.year_from is not None:
        out = out & (year >= s.year_from)
    if year is not None and s.year_to is not None:
        out = out & (year <= s.year_to)
    return out
