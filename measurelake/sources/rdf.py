"""Triples (s, p, o, lang) from Turtle and RDF/XML files. A file is read whole by one task, files by many."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TRIPLE = "s string, p string, o string, lang string"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|<(?P<iri>[^<>"{}|^`\\\s]*)>|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|@(?P<at>[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)"""
    r"""|(?P<number>[-+]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][-+]?\d+)?(?![\w:]))|(?P<name>[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-]))*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def turtle(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """Triples of a Turtle document: prefixes, bases, lists by `;` and `,`, literals, blank nodes and collections."""
    prefixes, base, blank = {}, "", 0
    found: list[tuple[str, str, str, str | None]] = []

    def tokens() -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle at {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[m.lastgroup]

    queue = [*tokens(), ("end", "")]
    queue.reverse()

    def name(kind: str, value: str) -> str:
        if kind == "iri":
            return urljoin(base, _unescaped(value)) if base else _unescaped(value)
        if value.startswith("_:"):
            return value
        prefix, _, rest = value.partition(":")
        return prefixes[prefix] + rest

    def node() -> tuple[str, str | None]:
        nonlocal blank
        kind, value = queue.pop()
        if kind in ("iri", "name"):
            return name(kind, value), None
        if kind in ("text", "long"):
            literal, lang = _unescaped(value[3:-3] if kind == "long" else value[1:-1]), None
            if queue[-1][0] == "at":
                lang = queue.pop()[1].lower()
            elif queue[-1][0] == "type":
                queue.pop()
                queue.pop()
            return literal, lang
        if kind in ("number", "word"):
            return value, None
        if value == "[":
            blank += 1
            own = f"_:b{blank}"
            predicates(own, "]")
            return own, None
        if value == "(":
            items = []
            while queue[-1][1] != ")" or queue[-1][0] != "mark":
                items.append(node())
            queue.pop()
            after = f"{_RDF}nil"
            for item in reversed(items):
                blank += 1
                own = f"_:b{blank}"
                found.extend([(own, f"{_RDF}first", *item), (own, f"{_RDF}rest", after, None)])
                after = own
            return after, None
        raise ValueError(f"a node was expected, not {value!r}")

    def predicates(subject: str, close: str) -> None:
        while True:
            kind, value = queue.pop()
            if kind == "mark" and value == close:
                return
            if kind == "mark" and value == ";":
                continue
            predicate = f"{_RDF}type" if (kind, value) == ("word", "a") else name(kind, value)
            while True:
                found.append((subject, predicate, *node()))
                if queue[-1] != ("mark", ","):
                    break
                queue.pop()

    while queue[-1][0] != "end":
        kind, value = queue[-1]
        directive = value.lower() if kind in ("at", "word") else ""
        if directive in ("prefix", "base"):
            queue.pop()
            key = queue.pop()[1] if directive == "prefix" else ""
            target = name(*queue.pop())
            if directive == "base":
                base = target
            else:
                prefixes[key.rstrip(":")] = target
            if kind == "at":
                queue.pop()
            continue
        subject = node()[0]
        if queue[-1] == ("mark", "."):  # a blank node with its own predicates
            queue.pop()
        else:
            predicates(subject, ".")
    yield from found


def rdf_xml(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """Triples of an RDF/XML document: typed nodes, nested nodes, resources, literals and property attributes."""
    blank = 0
    iri = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    found: list[tuple[str, str, str, str | None]] = []

    def node(e: ElementTree.Element, base: str, lang: str | None) -> str:
        nonlocal blank
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        about, own_id, node_id = (e.get(f"{{{_RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        if about is not None:
            subject = urljoin(base, about)
        elif own_id is not None:
            subject = f"{base}#{own_id}"
        elif node_id is not None:
            subject = f"_:{node_id}"
        else:
            blank += 1
            subject = f"_:b{blank}"
        if iri(e.tag) != f"{_RDF}Description":
            found.append((subject, f"{_RDF}type", iri(e.tag), None))
        found.extend((subject, iri(k), v, lang) for k, v in e.attrib.items() if not k.startswith((f"{{{_RDF}}}", _XML)))
        for p in e:
            own_lang, resource = p.get(f"{_XML}lang", lang), p.get(f"{{{_RDF}}}resource")
            if resource is not None:
                found.append((subject, iri(p.tag), urljoin(base, resource), None))
            elif p.get(f"{{{_RDF}}}nodeID") is not None:
                found.append((subject, iri(p.tag), "_:" + p.get(f"{{{_RDF}}}nodeID"), None))
            elif len(p):
                found.extend([(subject, iri(p.tag), node(c, base, own_lang), None) for c in p])
            else:
                typed = p.get(f"{{{_RDF}}}datatype") is not None
                found.append((subject, iri(p.tag), p.text or "", None if typed else own_lang and own_lang.lower()))
        return subject

    root = ElementTree.fromstring(text)
    base, lang = root.get(f"{_XML}base", ""), root.get(f"{_XML}lang")
    for e in root if iri(root.tag) == f"{_RDF}RDF" else [root]:
        node(e, base, lang)
    yield from found


def _read(spark: SparkSession, paths: str | list[str], parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                rows = list(parse(text.as_py()))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[at : at + 10_000])], ["s", "p", "o", "lang"])

    return spark.read.text(paths, wholetext=True).mapInArrow(run, TRIPLE)


def read_turtle(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The distinct triples of one or more Turtle files, united."""
    return _read(spark, paths, turtle).distinct()


def read_rdf_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The distinct triples of one or more RDF/XML files, united."""
    return _read(spark, paths, rdf_xml).distinct()
