"""Readers and writers against small files whose content is known."""

from __future__ import annotations

from measurelake.sources import files, rdf

X = "http://x.org/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix : <http://x.org/> .\nPREFIX q: <http://x.org/q/>\n# note\n:M a q:Unit ; q:label "metre"@en , "Meter"@de-DE ; q:factor 1.0 ; q:info [ q:k "v\\n\\"w\\"" ] ; q:code """a "b" c"""^^q:s .\n:M.2 a q:Unit .\n')
    (tmp_path / "b.ttl").write_text("@prefix : <http://x.org/> .\n:M a <http://x.org/q/Unit> .\n:L :has ( :M ) .\n")
    got = {tuple(r) for r in rdf.read_turtle(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")]).collect()}
    q = X + "q/"
    rest = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    assert got == {
        (X + "M", TYPE, q + "Unit", None), (X + "M", q + "label", "metre", "en"), (X + "M", q + "label", "Meter", "de-de"), (X + "M", q + "factor", "1.0", None), (X + "M", q + "info", "_:b1", None),
        ("_:b1", q + "k", 'v\n"w"', None), (X + "M", q + "code", 'a "b" c', None), (X + "M.2", TYPE, q + "Unit", None), (X + "L", X + "has", "_:b1", None), ("_:b1", rest + "first", X + "M", None), ("_:b1", rest + "rest", rest + "nil", None),
    }


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "a.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:q="http://x.org/q/" xml:base="http://x.org/"><q:Unit rdf:about="M"><q:label xml:lang="en">metre</q:label><q:same rdf:resource="N"/><q:info><q:Note q:k="v"/></q:info></q:Unit></rdf:RDF>')
    got = {tuple(r) for r in rdf.read_rdf_xml(spark, str(tmp_path / "a.rdf")).collect()}
    q = X + "q/"
    assert got == {(X + "M", TYPE, q + "Unit", None), (X + "M", q + "label", "metre", "en"), (X + "M", q + "same", X + "N", None), (X + "M", q + "info", "_:b1", None), ("_:b1", TYPE, q + "Note", None), ("_:b1", q + "k", "v", None)}


def test_tei(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<TEI><text><p>It is <measure type="value"><num>5</num> <measure type="LENGTH" unit="m">m</measure></measure> long<!-- x --> in <measure type="DATE">2020</measure>.<list><item>no</item></list></p><p>None</p></text></TEI>')
    got = [r.asDict(recursive=True) for r in files.read_tei(spark, str(tmp_path)).orderBy("paragraph").collect()]
    assert got == [{"source": "a.xml", "paragraph": 0, "text": "It is 5 m long in 2020.", "spans": [{"start": 6, "end": 9, "type": "value", "surface": "5 m"}]}, {"source": "a.xml", "paragraph": 1, "text": "None", "spans": []}]


def test_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"u/M": ["m", "metre"],\n "u/S": []}')
    got = {tuple(r) for r in files.read_surfaces(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("u/M", "m"), ("u/M", "metre")}
    files.write_lookup(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1), str(tmp_path / "out"))
    files.write_lookup(spark.createDataFrame([(2, "y")], "a int, b string").coalesce(1), str(tmp_path / "out"))
    rows = files.read_results(spark, str(tmp_path / "out"), "part", "a int, b string").collect()
    assert [(r.a, r.b) for r in rows] == [(2, "y")] and rows[0].file.startswith("part")
