"""Readers, writers, connectors, cache, walk and the iterated estimates."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import citations_graph as G
from tessella.operators import literature as L
from tessella.operators import synthesis as S
from tessella.operators.cache import ResultCache, cache_key
from tessella.sources import connectors, records, sinks, texts


def _docx(path, xml):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    path.write_bytes(buffer.getvalue())


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    _docx(tmp_path / "a.docx", f'<w:document {ns}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Aim</w:t></w:r></w:p><w:p><w:r><w:t>Tea helps</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>3</w:t></w:r></w:p></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.body) for r in texts.read_docx(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", "heading", "Aim"), ("a.docx", "prose", "Tea helps[3]"), ("b.docx", "gap", "BadZipFile")}


def test_corpus_and_pdf(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two  three\nfour five")
    (tmp_path / "b.html").write_text("<p>one two three four five six</p><script>x</script>")
    (tmp_path / "c.txt").write_text("short")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    rows, gaps = texts.read_corpus(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r.text for r in rows.collect()}
    assert found["a.txt"] == "one two three four five" and found["b.html"] == "one two three four five six"
    assert any(r.path.endswith("c.txt") for r in gaps.collect())
    assert [r.reason for r in texts.read_pdf_gaps(spark, str(tmp_path)).collect()] == ["no_pdf_extractor"]


def test_scan_gives_a_row_for_every_file(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "a.txt").write_text("one two  three\nfour five")
    (tmp_path / "b.HTML").write_text("<p>one two three four five</p>")
    (tmp_path / "c.md").write_text("short")
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"one two three four \xff\xfe five")
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "g.zip").write_bytes(b"PK")
    (tmp_path / "i j.txt").write_text("one two three four five")
    (tmp_path / "h.txt").write_text("gone before it is read, but named")
    rows = texts.scan_corpus(spark, str(tmp_path))
    (tmp_path / "h.txt").unlink()
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.text, r.reason) for r in rows.collect()}
    few = (None, "fewer words than needed")
    assert got == {
        "a.txt": ("one two three four five", None), "b.HTML": ("one two three four five", None), "c.md": few, "d.txt": (None, "empty or unreadable"), "e.txt": (None, "not UTF-8"),
        "f.pdf": (None, "no_pdf_extractor"), "g.zip": (None, "unsupported"), "h.txt": (None, "empty or unreadable"), "i j.txt": ("one two three four five", None),
    }
    (tmp_path / "none").mkdir()
    assert texts.scan_corpus(spark, str(tmp_path / "none")).count() == 0


def test_findings_in_order(spark, tmp_path):
    found = spark.createDataFrame([(i, f"a|{i}", None) for i in range(40, 0, -1)], "id int, what string, value string")
    gaps = spark.createDataFrame([], "path string, reason string")
    sinks.write_findings(found, gaps, str(tmp_path), ["id"])
    lines = lambda name: [x for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]
    assert lines("findings.md") == ["| id | what | value |", "| --- | --- | --- |", *(f"| {i} | a\\|{i} |  |" for i in range(1, 41))]
    assert lines("input_gaps.md") == ["| path | reason |", "| --- | --- |"]


def test_csv_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", cell'), (2, "line\nend")], "id int, text string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, records.read_csv(spark, str(tmp_path / "c"), "id int, text string").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"x": 1}')
    (tmp_path / "j" / "b.json").write_text("{broken")
    got = records.read_json(spark, str(tmp_path / "j"), "x int").collect()
    assert {(r.x, r._corrupt is None) for r in got} == {(1, True), (None, False)}
    with pytest.raises(ValueError):
        records.read_json(spark, str(tmp_path / "j"), "x int", most_bytes=3)


def test_snapshots_and_tables(spark, tmp_path):
    for v in (1, 2):
        sinks.snapshot(spark.createDataFrame([("a", v)], "k string, n long"), str(tmp_path / "s"), v)
    assert [tuple(r) for r in sinks.load_snapshot(spark, str(tmp_path / "s"), "k string, n long").collect()] == [("a", 2)]
    df = spark.createDataFrame([("a|b", "<x>")], "p string, q string")
    assert sinks.markdown_table(df, ["p", "q"]).endswith("| a\\|b | <x> |")
    assert "&lt;x&gt;" in sinks.html_report(df, ["p", "q"], "t")
    assert sinks.mermaid(spark.createDataFrame([("a", "b")], "src string, dst string")) == "flowchart TD\n  a --> b"
    sinks.write_verdicts(df, df, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v/verdicts")).count() == 1


def test_federated(spark):
    @connectors.register("good")
    def good(query, limit):
        return [{"paper_id": str(i), "title": query} for i in range(limit)]

    @connectors.register("none")
    def none(query, limit):
        return []

    @connectors.register("down")
    def down(query, limit):
        raise connectors.Unavailable("busy", 429, 1.0)

    papers, status = connectors.federated(spark, "tea", ["good", "none", "down", "unknown"], 3)
    assert papers.count() == 3
    assert {(r.source, r.status, r.returned) for r in status.collect()} == {("good", "ok", 3), ("none", "empty", 0), ("down", "unavailable", 0)}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise connectors.Unavailable("later", 503)
        return [{}]

    assert connectors.with_retries(flaky, sleep=lambda s: None) == [{}]
    assert connectors.looser(L.ladder("tea studies"), lambda q: [1] if q.startswith("(") else [])[1] == [1]
    assert records.page_tokens(25, 10) == [(0, 10), (10, 10), (20, 5)]


def test_cache(spark, tmp_path):
    now = [0.0]
    cache = ResultCache(spark, str(tmp_path / "cache"), ttl=10, clock=lambda: now[0])
    key = cache_key("search", query="tea", limit=3)
    assert key == cache_key("search", limit=3, query="tea")
    assert cache.get(key) is None
    cache.set(key, spark.range(3))
    assert cache.get(key).count() == 3
    now[0] = 11
    assert cache.get(key) is None and cache.clear_expired() == 1 and cache.stats() == {"entries": 0, "hits": 1, "misses": 2}


def test_walk(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 4)], "src long, dst long")
    citations = spark.createDataFrame([(2, 5), (3, 1), (4, 2)], "id long, n long")
    seeds = spark.createDataFrame([("a", 1), ("b", 7)], "walk string, id long")
    path = G.walk(edges, citations, seeds, steps=4)
    assert {tuple(r) for r in G.walk_stats(path, edges).collect()} == {("a", 4, 2, 2, 3, 1), ("b", 0, 0, 0, 1, 0)}  # 2 to 1 is met, not walked
    got = {(r.walk, r.step): (r.id, r.move) for r in path.collect()}
    assert got == {("a", 0): (1, "seed"), ("a", 1): (2, "forward"), ("a", 2): (4, "forward"), ("a", 3): (2, "back"), ("a", 4): (1, "back"), ("b", 0): (7, "seed")}


def test_reml_is_the_root_of_its_score(spark):
    rng = np.random.default_rng(5)
    v = rng.uniform(0.02, 0.2, 13)
    y = rng.normal(0.3, np.sqrt(v + 0.1))
    df = spark.createDataFrame([("a", float(a), float(np.sqrt(b))) for a, b in zip(y, v, strict=True)], "g string, yi double, sei double")
    got = S.reml(df, ["g"]).first()

    def score(t):
        w = 1 / (v + t)
        m = (w * y).sum() / w.sum()
        return -0.5 * (w.sum() - (w**2).sum() / w.sum()) + 0.5 * ((w**2) * (y - m) ** 2).sum()

    lo, hi = 0.0, 5.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    assert got.tau2 == pytest.approx(lo, abs=1e-6)


def test_pool_of_equal_studies(spark):
    df = spark.createDataFrame([("a", 0.5, 0.1)] * 3 + [("b", 0.2, 0.3)] + [("b", None, 0.1)], "g string, yi double, sei double")
    got = {r.g: r for r in S.pool(df, ["g"]).collect()}
    assert got["a"].fe == pytest.approx(0.5) and got["a"].tau2 == 0 and got["a"].i2 is None
    assert got["b"].k == 1 and got["b"].hk_se is None


def test_names(spark):
    rows = spark.sql("SELECT * FROM VALUES ('Lee', 'Lee, K') AS t(a, b)")
    assert rows.select(L.same_person(F.col("a"), F.col("b"), family_only=True)).first()[0] is True
