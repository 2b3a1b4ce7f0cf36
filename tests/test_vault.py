import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, context, graph, lexical
from quillspark.sources import vault

_PAGES = {
    "one/index.md": "not a page",
    "one/plain.md": "no frontmatter",
    "one/a.md": "---\ntype: Note\ntitle: Alpha\nstatus: active\nsuperseded_by: b.md\nrelationships:\n- {type: contradicts, target: sub/c.md}\nmaintenance:\n- {kind: stale, reason: old, observed_at: 2024-01-01T00:00:00Z}\n- {kind: duplicate, reason: same, observed_at: 2024-01-01T00:00:00Z, target: gone.md}\n---\n[b](b) [c](sub/c.md) [n](nowhere.md) text ^[ambiguous]",
    "one/b.md": "---\ntype: Note\ntitle: alpha\nsuperseded_by: a.md\ntags: [Big-Data]\nstatus: retired\n---\nbody of beta",
    "one/sub/c.md": "---\ntype: Concept\ntitle: Note\ndescription: what a note is\ntags: [big data]\n---\n[a](../a.md)",
    "two/b.md": "---\ntype: Note\ntitle: Other\n---\nhidden by the first source",
    "two/d.md": "---\ntype: Note\ntitle: Delta\n---\n[up](/a.md)",
}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vaults")
    for path, text in _PAGES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    both = vault.compose(spark, [("v1", str(root / "one")), ("v2", str(root / "two"))])
    return vault.effective(both).cache()


def test_scan_and_overlay(pages):
    got = {r.path: (r.vault, r.title) for r in pages.collect()}
    assert got == {"a.md": ("v1", "Alpha"), "b.md": ("v1", "alpha"), "sub/c.md": ("v1", "Note"), "d.md": ("v2", "Delta")}


def test_strict_scan_fails_on_bad_pages(spark, tmp_path):
    (tmp_path / "bad.md").write_text("---\n[1\n---\n")
    assert vault.scan(spark, str(tmp_path), tolerant=True).where("problem IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="yaml"):
        vault.scan(spark, str(tmp_path)).collect()


EDGES = {("a.md", "c.md", "contradicts"), ("a.md", "b.md", "superseded_by"), ("b.md", "a.md", "superseded_by"), ("c.md", "a.md", "links_to"), ("d.md", "a.md", "links_to")}


def test_edges_and_audit(pages):
    edges = vault.edges(pages).cache()
    got = {(r.from_uri[-4:], r.to_uri[-4:], r.relation) for r in edges.collect()}
    assert got == EDGES
    trust = vault.trust(pages)
    found = audit.ordered(
        audit.authored(vault.marks(pages)), audit.orphans(pages, edges), audit.superseded(vault.succession(pages), trust), audit.retired_references(edges, trust),
        audit.duplicate_identities(pages), audit.tag_fragments(pages), audit.ambiguities(pages), audit.contradictions(edges),
    )
    classes = [r["class"] for r in found.collect()]
    assert set(classes) == {"authored_stale", "authored_duplicate", "broken_maintenance_target", "orphan", "cyclic_supersession", "duplicate_identity", "tag_fragmentation", "ambiguity", "contradiction"}
    severities = [r["severity"] for r in found.collect()]
    assert severities == sorted(severities, key=("high", "medium", "low").index)
    old, unknown = audit.stale(trust.withColumn("committed_at", F.lit(None).cast("string")), "2025-01-01T00:00:00Z", "24h")
    assert old.count() == 0 and unknown.count() == 4


def test_validation_index_and_rendering(pages):
    messages = {(r.path, r.message.split(":")[0]) for r in vault.validate(pages, pages.where("type = 'Concept'")).collect()}
    assert ("a.md", "link to nothing") in messages
    listing = {r.dir: r.content for r in vault.index_pages(pages).collect()}
    assert listing[""].startswith("- sub/\n- [Alpha](a.md)") and listing["sub"] == "- [Note](c.md)"
    assert "(kb://v1/b.md)" in vault.rendered(pages, "kb://v1/a.md") and "(nowhere.md)" in vault.rendered(pages, "kb://v1/a.md")
    assert {r.name: r.description for r in vault.first_per_type(pages).collect()} == {"Note": "what a note is", "Concept": "Concept"}


def test_plans_bind_what_they_saw(pages):
    text = "---\ntype: Note\ntitle: New\n---\n[a](a.md)"
    plan = vault.plan_change(pages, "v1", "new.md", text, None)
    assert plan["edges"] == [("added", "kb://v1/new.md", "kb://v1/a.md", "links_to")] and plan == vault.plan_change(pages, "v1", "new.md", text, None)
    with pytest.raises(ValueError, match="expected"):
        vault.plan_change(pages, "v1", "a.md", text, None)


def test_lexical_answers(pages):
    asked = lexical.query(pages, "Delta")
    assert asked["kind"] == "direct" and asked["candidates"][0]["uri"].endswith("d.md")
    path = lexical.query(pages, "how is Delta connected to beta?", edges=vault.edges(pages))
    assert path["kind"] == "path" and path["path"][0].endswith("d.md") and path["path"][-1].endswith("b.md")
    assert lexical.query(pages, "unknownword")["index_only"] and lexical.query(pages, "")["candidates"] == []


def test_sources_in_order():
    configs = {"x": {"vault": "X", "imports": ["y", "z"]}, "y": {"vault": "Y", "imports": ["z"]}, "z": {"vault": "Z"}}
    assert vault.ordered_sources(configs, "x") == [("X", "x"), ("Y", "y"), ("Z", "z")]
    with pytest.raises(ValueError, match="cycle"):
        vault.ordered_sources({"x": {"vault": "X", "imports": ["x"]}}, "x")


def test_evidence_for_a_question(pages):
    edges, trust = vault.edges(pages), vault.trust(pages)
    got = context.resolve(pages, trust, "alpha beta", edges=edges, constraints={"type": "Note"})
    assert {e["uri"][-4:] for e in got["evidence"]} == {"a.md", "b.md"} and got["paths"]
    few = context.resolve(pages, trust, "alpha beta", most_items=1, most_chars=5, constraints={"status": "active"})
    assert len(few["evidence"]) == 1 and len(few["evidence"][0]["content"]) == 5 and few["evidence"][0]["truncated"] and ("kb://v1/b.md", "status") in few["omissions"]
    near = pages.sparkSession.createDataFrame([("kb://gone/x.md", 1), ("kb://v2/d.md", 2)], "uri string, position int")
    mixed = context.resolve(pages, trust, "alpha", strategy="vector", vector=near)
    assert ("kb://gone/x.md", "stale_candidate") in mixed["omissions"] and mixed["evidence"][0]["uri"] == "kb://v2/d.md"


def test_whole_audit_and_filters(pages):
    every = {r["class"] for r in vault.knowledge_audit(pages, now="2025-01-01T00:00:00Z", after="24h").collect()}
    assert {"orphan", "cyclic_supersession", "contradiction", "authored_stale"} <= every
    assert {r["class"] for r in vault.knowledge_audit(pages, types=("Concept",)).collect()} == set()


def test_writes(spark, pages, tmp_path):
    text = "---\ntype: Note\ntitle: New\n---\n[a](a.md)"
    digest = vault.plan_change(pages, "v1", "new.md", text, None)["digest"]
    with pytest.raises(ValueError, match="changed"):
        vault.apply_change(pages, str(tmp_path), "v1", "new.md", text, None, "sha256:0")
    assert vault.apply_change(pages, str(tmp_path), "v1", "new.md", text, None, digest)["written"] and (tmp_path / "new.md").read_text() == text
    assert not vault.write_page(spark, str(tmp_path), "new.md", text)
    assert vault.add_memory(pages, str(tmp_path), "likes tea", "u", "g") == "ADD"
    found = vault.scan(spark, str(tmp_path), "v1")
    assert vault.add_memory(found, str(tmp_path), "likes tea ", "u", "g") == "NOOP" and vault.newest_memory(found, "x", "g").count() == 0


def test_procedures(spark, tmp_path):
    body = "## Inputs\ni\n## Process\np\n## Completion\nc\n"
    (tmp_path / "p.md").write_text(f"---\ntype: Procedure\ntitle: P\ninvocation: model\ntags: [x, y]\n---\n{body}")
    (tmp_path / "q.md").write_text(f"---\ntype: Procedure\ntitle: Q\ninvocation: user\n---\n{body}")
    found = vault.procedures(vault.scan(spark, str(tmp_path)), ("x",)).collect()
    assert [r.title for r in found] == ["P"] and found[0].steps[0].process == "p"
    (tmp_path / "r.md").write_text("---\ntype: Procedure\ntitle: R\ninvocation: model\ntags: [x]\n---\nnothing")
    with pytest.raises(Exception, match="no inputs"):
        vault.procedures(vault.scan(spark, str(tmp_path)), ("x",)).collect()


def test_succession_and_references_are_judged_page_by_page(spark):
    """A to B to nothing, C to retired D, E to F to G, X to Y to Z to Y; an active page refers to D by two relations."""
    rows = [("A", "B", "b"), ("B", None, "gone"), ("C", "D", "d"), ("D", None, None), ("E", "F", "f"), ("F", "G", "g"), ("G", None, None), ("X", "Y", "y"), ("Y", "Z", "z"), ("Z", "Y", "y")]
    pages = spark.createDataFrame(rows, "uri string, next string, authored string")
    trust = spark.createDataFrame([(r[0], "archived" if r[0] == "D" else "active") for r in rows], "uri string, status string")
    found = {(r["class"].split("_")[0], tuple(r["uris"])) for r in audit.superseded(pages, trust).collect()}
    assert found == {("broken", ("B",)), ("non", ("A", "B")), ("non", ("C", "D")), ("non", ("E", "F")), ("cyclic", ("X", "Y", "Y", "Z")), ("cyclic", ("Y", "Z"))}
    some = audit.superseded(pages, trust, trust.where("uri IN ('A', 'Z')").select("uri")).collect()
    assert {(r["class"].split("_")[0], tuple(r["uris"])) for r in some} == {("non", ("A", "B")), ("cyclic", ("Y", "Z"))}
    edges = spark.createDataFrame([("C", "D", "superseded_by"), ("A", "D", "cites"), ("A", "D", "links_to"), ("N", "D", "cites"), ("D", "D", "cites"), ("A", "G", "cites")], "from_uri string, to_uri string, relation string")
    refs = audit.retired_references(edges, trust).collect()
    assert sorted((r["evidence"][0], r["evidence"][1]) for r in refs) == [("A", "cites"), ("A", "links_to"), ("N", "cites")]
    assert {(r["classification"], r["author_decision"]) for r in refs} == {("fact", False)}
    both = audit.contradictions(edges.withColumn("relation", F.lit("contradicts"))).select("classification", "author_decision").distinct().collect()
    assert [tuple(r) for r in both] == [("candidate", True)]
