"""Vaults of Markdown pages: scan, overlay of several sources, link resolution, trust facts, validation, index pages."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import markup
from quillspark.operators import graph, history, paging

PAGE = (
    "vault string, root string, precedence int, path string, uri string, title string, description string, type string, aliases array<string>, tags array<string>, body string, metadata string, "
    "relationships array<struct<type:string,target:string>>, links array<string>, maintenance array<struct<kind:string,reason:string,observed_at:string,author:string,target:string>>, "
    "claims array<struct<kind:string,line:int,column:int>>, sections array<struct<section:string,content:string>>, problem string, problems array<string>, revision string"
)
_NAMES = "vault root precedence path uri title description type aliases tags body metadata relationships links maintenance claims sections problem problems revision".split()
# Names that are never pages, and folders that are not walked.
RESERVED, SKIPPED = ("index.md", "log.md"), (".git", ".obsidian")
#: The bundled source's name, and its pages: path -> type, title, body.
BUNDLE = "core"
BUNDLED = {
    "concepts/concept.md": ("Concept", "Concept", "A page that says what a type of page is for. Its title is the type's name, and its path the folder of such pages."),
    "concepts/procedure.md": ("Concept", "Procedure", "A way to do something, in steps. Each step has inputs, a process and how to see that it is complete."),
    "concepts/memory.md": ("Concept", "Memory", "A fact that one user's agent is to keep. It is found by that user and agent only."),
}


def scan(spark: SparkSession, root: str, vault: str = "default", precedence: int = 0, tolerant: bool = False) -> DataFrame:
    """Pages under a folder. Files without frontmatter are left out; any other unreadable page fails a strict scan, and is
    kept with its problem in a tolerant one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select("path", "content")
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.expr("regexp_replace(path, '^file:(//)?', '')"), "^" + re.escape(base) + "/?", "")
    skipped = "(^|/)(" + "|".join(s.replace(".", "[.]") for s in SKIPPED) + ")/|^documentation/|(^|/)(" + "|".join(r.replace(".", "[.]") for r in RESERVED) + ")$"
    kept = files.select(relative.alias("path"), "content").where(~F.col("path").rlike(skipped))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                found = markup.parse_page(path, data)
                if found["problem"] == "no frontmatter" and not tolerant:
                    continue
                if found["problem"] and not tolerant:
                    raise ValueError(f"{path}: {found['problem']}")
                rows.append({"vault": vault, "root": base, "precedence": precedence, "path": path, "uri": markup.uri_of(vault, path), "revision": f"sha256:{hashlib.sha256(data).hexdigest()}", **found})
            yield pd.DataFrame(rows, columns=_NAMES)

    return kept.mapInPandas(parse, PAGE)


def compose(spark: SparkSession, sources: list[tuple[str, str]], tolerant: bool = False) -> DataFrame:
    """Pages of several (vault, root), the first source of a path winning. A root counts once."""
    once = list({root: vault for vault, root in reversed(sources)}.items())[::-1]
    return reduce(DataFrame.unionByName, [scan(spark, root, vault, i, tolerant) for i, (root, vault) in enumerate(once)])


def ordered_sources(configs: dict[str, dict], first: str) -> list[tuple[str, str]]:
    """(vault, root) depth-first through imports in declared order, each root once; a cycle of imports is an error."""
    out: list[tuple[str, str]] = []
    seen: set[str] = set()

    def visit(root: str, path: tuple[str, ...]) -> None:
        if root in path:
            raise ValueError(f"imports form a cycle: {' -> '.join([*path, root])}")
        if root in seen:
            return
        seen.add(root)
        out.append((configs[root]["vault"], root))
        for other in configs[root].get("imports", []):
            visit(other, (*path, root))

    visit(first, ())
    return out


def effective(pages: DataFrame) -> DataFrame:
    return history.overlay(pages)


def _candidates():  # noqa: ANN202  a user-defined function
    @F.udf("array<string>", useArrow=True)
    def made(path: str, raw: str) -> list[str]:
        found = markup.destination(raw or "")
        if not found:
            return []
        kind, target = found
        return [target] if kind == "uri" else [] if kind == "invalid" else markup.candidates(path, kind, target)

    return made


def resolve(pages: DataFrame, authored: DataFrame) -> DataFrame:
    """(from_uri, raw, ord) -> with to_uri, the page of the first candidate that there is, or null.

    Candidates are exploded with their rank and joined with the pages' paths and uris."""
    made = _candidates()
    keyed = authored.join(pages.select(F.col("uri").alias("from_uri"), "path"), "from_uri").select("from_uri", "raw", "ord", F.posexplode_outer(made("path", "raw")).alias("rank", "key"))
    keys = pages.select(F.col("path").alias("key"), F.col("uri").alias("to_uri")).unionByName(pages.select(F.col("uri").alias("key"), F.col("uri").alias("to_uri")))
    met = keyed.join(keys, "key", "left")
    return met.groupBy("from_uri", "raw", "ord").agg(F.min_by("to_uri", F.when(F.col("to_uri").isNotNull(), F.col("rank"))).alias("to_uri"))


def edges(pages: DataFrame) -> DataFrame:
    """The effective view's edges: relationships, links without one, and resolved successions."""
    typed = pages.select(F.col("uri").alias("from_uri"), F.posexplode("relationships").alias("ord", "r")).select("from_uri", "ord", F.col("r.type").alias("relation"), F.col("r.target").alias("raw"))
    links = pages.select(F.col("uri").alias("from_uri"), F.posexplode("links").alias("ord", "raw"))
    found = resolve(pages, typed.select("from_uri", "raw", "ord")).join(typed, ["from_uri", "raw", "ord"]).where("to_uri IS NOT NULL")
    plain = resolve(pages, links).where("to_uri IS NOT NULL")
    next_ = succession(pages).where("next IS NOT NULL AND next <> uri").select(F.col("uri").alias("from_uri"), F.col("next").alias("to_uri"), F.lit("superseded_by").alias("relation"), F.col("authored").alias("raw"), F.lit(-1).alias("ord"))
    return graph.build_edges(found.select("from_uri", "to_uri", "relation", "raw", "ord").unionByName(next_), plain.select("from_uri", "to_uri", "raw", "ord"))


def succession(pages: DataFrame) -> DataFrame:
    """(uri, next, authored) from ``superseded_by``."""
    authored = pages.select(F.col("uri").alias("from_uri"), F.get_json_object("metadata", "$.superseded_by").alias("raw"), F.lit(0).alias("ord")).where("raw IS NOT NULL")
    found = resolve(pages, authored).select(F.col("from_uri").alias("uri"), F.col("to_uri").alias("next"), F.col("raw").alias("authored"))
    return pages.select("uri").join(found, "uri", "left")


def trust(pages: DataFrame) -> DataFrame:
    """Status, confidence, interval, tier and the like, from the frontmatter."""
    text = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    confidence = F.get_json_object("metadata", "$.confidence").try_cast("double")
    names = ("status", "source", "valid_from", "valid_until", "observed_at", "occurred_at", "tier")
    return pages.select("uri", "type", "tags", *[text(n) for n in names], F.when(~F.isnan(confidence) & (F.abs(confidence) < float("inf")), confidence).alias("confidence"))


def marks(pages: DataFrame) -> DataFrame:
    """(uri, maintenance) with each mark's target resolved, as ``audit.authored`` takes it."""
    flat = pages.select("uri", F.posexplode("maintenance").alias("ord", "m"))
    found = resolve(pages, flat.where("m.target IS NOT NULL").select(F.col("uri").alias("from_uri"), F.col("m.target").alias("raw"), "ord"))
    met = flat.join(found.select(F.col("from_uri").alias("uri"), "ord", F.col("to_uri").alias("target_uri")), ["uri", "ord"], "left")
    return met.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("m.kind").alias("kind"), F.col("m.reason").alias("reason"), F.col("m.target").alias("target"), "target_uri"))).alias("x")).select("uri", F.transform("x", lambda i: F.struct(i["kind"].alias("kind"), i["reason"].alias("reason"), i["target"].alias("target"), i["target_uri"].alias("target_uri"))).alias("maintenance"))


def validate(pages: DataFrame, concept_types: DataFrame | None = None) -> DataFrame:
    """(path, severity, message) in order, from a tolerant scan: unreadable pages, bad metadata, links to nothing, types
    without exactly one Concept page."""
    unreadable = pages.where("problem IS NOT NULL AND problem <> 'no frontmatter'").select("path", F.lit("error").alias("severity"), F.col("problem").alias("message"))
    bad = pages.select("path", F.lit("error").alias("severity"), F.explode("problems").alias("message"))
    links = pages.select(F.col("uri").alias("from_uri"), F.posexplode("links").alias("ord", "raw"))
    inside = resolve(pages, links).where("to_uri IS NULL").join(pages.select(F.col("uri").alias("from_uri"), "path"), "from_uri")
    is_internal = F.udf(lambda raw: markup.destination(raw) is not None, "boolean", useArrow=True)
    broken = inside.where(is_internal("raw")).select("path", F.lit("warning").alias("severity"), F.concat(F.lit("link to nothing: "), "raw").alias("message"))
    names = F.when(F.col("type").rlike(r"^\p{Lu}[\p{L}\p{Nd}]*$"), None).otherwise(F.concat(F.lit("not a type name: "), "type"))
    typed = pages.where("type <> ''").select("path", F.lit("warning").alias("severity"), names.alias("message")).where("message IS NOT NULL")
    found = reduce(DataFrame.unionByName, [unreadable, bad, broken, typed])
    if concept_types is not None:
        known = concept_types.groupBy(F.col("title").alias("type")).agg(F.count("*").alias("n"))
        missing = pages.where("type <> '' AND type <> 'Concept'").join(known, "type", "left").where("n IS NULL OR n <> 1")
        found = found.unionByName(missing.select("path", F.lit("warning").alias("severity"), F.concat(F.lit("type without one Concept page: "), "type").alias("message")))
    return found.distinct().orderBy("path", "severity", "message")


def index_lines(pages: DataFrame) -> DataFrame:
    """(dir, kind, line) of the index of each folder: its folders (kind 0) and its pages (kind 1). No folder is gathered."""
    cut = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    own = pages.select(cut.alias("dir"), F.lit(1).alias("kind"), F.concat(F.lit("- ["), "title", F.lit("]("), F.substring_index("path", "/", -1), F.lit(")")).alias("line"))
    up = own.where("dir <> ''").select("dir").distinct()
    chain = up.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))).alias("d")).distinct()
    folders = chain.select(F.when(F.instr("d", "/") > 0, F.regexp_replace("d", "/[^/]*$", "")).otherwise("").alias("dir"), F.lit(0).alias("kind"), F.concat(F.lit("- "), F.substring_index("d", "/", -1), F.lit("/")).alias("line"))
    return own.unionByName(folders)


def index_pages(pages: DataFrame) -> DataFrame:
    """(dir, content) of an index page for each folder: its folders, then its pages, by name. A page is one text, so a
    folder's lines meet in a task here; ``index_lines`` has them as rows."""
    return index_lines(pages).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("kind", "line"))).alias("x")).select("dir", F.array_join(F.transform("x", lambda i: i["line"]), "\n").alias("content"))


def rendered(pages: DataFrame, uri: str) -> str:
    """A page's body with links to known pages as canonical uris."""
    one = pages.where(F.col("uri") == uri)
    links = one.select(F.col("uri").alias("from_uri"), F.posexplode("links").alias("ord", "raw"))
    new = {r["raw"]: markup.with_suffix(r["to_uri"], r["raw"]) for r in resolve(pages, links).where("to_uri IS NOT NULL").collect()}
    row = one.select("body").first()
    if row is None:
        raise KeyError(uri)
    return markup.rewrite_links(row["body"], new)


def plan_change(pages: DataFrame, vault: str, path: str, content: str, expected: str | None) -> dict:
    """What writing a page would change: its diff, edges added and removed, and a digest that binds the plan.

    ``expected`` is the revision that is to be replaced, or null where no page may be there yet."""
    spark = pages.sparkSession
    uri = markup.uri_of(vault, path)
    now = pages.where(F.col("uri") == uri).select("revision", "body", "metadata").first()
    if (now["revision"] if now else None) != expected:
        raise ValueError("the page is not as expected")
    found = markup.parse_page(path, content.encode())
    if found["problem"] or found["problems"]:
        raise ValueError(f"not valid: {found['problem'] or found['problems']}")
    revision = f"sha256:{hashlib.sha256(content.encode()).hexdigest()}"
    row = {"vault": vault, "root": "", "precedence": 0, "path": path, "uri": uri, "revision": revision, **found}
    after = pages.where(F.col("uri") != uri).unionByName(spark.createDataFrame([row], PAGE))
    changed = [tuple(r) for r in history.edge_changes(edges(pages), edges(after)).orderBy("change", "from_uri", "to_uri", "relation").collect()]
    diff = markup.line_diff(now["body"] if now else "", found["body"])
    digest = hashlib.sha256(json.dumps([uri, expected, revision, diff, changed]).encode()).hexdigest()
    return {"uri": uri, "revision": revision, "diff": diff, "edges": changed, "digest": f"sha256:{digest}"}


def newest_memory(pages: DataFrame, user: str, agent: str) -> DataFrame:
    """Active memories of one user and agent; the scope is cut out before anything is ranked."""
    field = lambda n: F.get_json_object("metadata", f"$.{n}")
    return pages.where((F.col("type") == "Memory") & (field("status") == "active") & (field("user_id") == user) & (field("agent_id") == agent))


def first_per_type(pages: DataFrame) -> DataFrame:
    """(name, uri, description): each type in use, described by the first Concept page of that title."""
    first = Window.partitionBy("title").orderBy("precedence", "path")
    concepts = pages.where("type = 'Concept'").withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("title").alias("name"), "uri", "description")
    return pages.select(F.col("type").alias("name")).distinct().join(concepts, "name", "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), F.col("name")))


def write_page(spark: SparkSession, root: str, path: str, content: str) -> bool:
    """Puts a page in place by a rename that replaces an older one at once; false where it is there already, byte for byte."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    data = content.encode()
    if system.exists(target) and system.getFileStatus(target).getLen() == len(data):
        stream = system.open(target)
        try:
            if jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") == content:
                return False
        finally:
            stream.close()
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        own = Path(target.toUri().getPath())
        own.parent.mkdir(parents=True, exist_ok=True)
        new = own.with_name(f".{own.name}.{uuid.uuid4().hex}")
        new.write_bytes(data)
        own.with_name(f".{own.name}.crc").unlink(missing_ok=True)
        new.replace(own)
        return True
    new = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}.{uuid.uuid4().hex}.new")
    out = system.create(new, False)
    out.write(bytearray(data))
    out.close()
    replace = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 1)
    options[0] = replace
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(new, target, options)
    return True


def check_write(pages: DataFrame, root: str, vault: str, path: str, content: str, update: bool = False) -> dict:
    """What a page that is to be written says, or an error: it needs a title and one Concept page of its type, must lie
    under that page's ``path``, its links must lead to pages, and no other root may have its path unless it is an update."""
    found = markup.parse_page(path, content.encode())
    if found["problem"] or found["problems"]:
        raise ValueError(f"not valid: {found['problem'] or found['problems']}")
    if not json.loads(found["metadata"] or "{}").get("title"):
        raise ValueError("a title is required")
    concepts = pages.where((F.col("type") == "Concept") & (F.col("title") == found["type"])).select(F.get_json_object("metadata", "$.path").alias("folder")).limit(2).collect()
    if len(concepts) != 1:
        raise ValueError(f"{'several Concept pages' if concepts else 'no Concept page'} with the title {found['type']!r}")
    folder = posixpath.normpath(concepts[0]["folder"] or "")
    if not concepts[0]["folder"] or folder.startswith(("/", "..")):
        raise ValueError(f"the Concept page {found['type']!r} has no path inside the vault")
    if folder != "." and not posixpath.normpath(path).startswith(f"{folder}/"):
        raise ValueError(f"{path} is outside {folder}, the path of {found['type']!r}")
    spark = pages.sparkSession
    mine = spark.createDataFrame([(root, path)], "root string, path string")
    if not update and not paging.external_collisions(mine, pages.select("root", "path")).isEmpty():
        raise ValueError(f"{path} exists outside this vault already")
    uri = markup.uri_of(vault, path)
    known = pages.select("uri", "path").unionByName(spark.createDataFrame([(uri, path)], "uri string, path string")).distinct()
    inside = [(uri, raw, i) for i, raw in enumerate(found["links"]) if markup.destination(raw) is not None]
    if inside:
        missing = resolve(known, spark.createDataFrame(inside, "from_uri string, raw string, ord int")).where("to_uri IS NULL").first()
        if missing is not None:
            raise ValueError(f"link to nothing: {missing['raw']}")
    return {"uri": uri, **found}


def vaults(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """(vault, root, precedence) of the sources, with the bundled one last unless it is among them."""
    rows = [(vault, root, i) for i, (vault, root) in enumerate(sources)]
    if BUNDLE not in {vault for vault, _ in sources}:
        rows.append((BUNDLE, "", len(rows)))
    return spark.createDataFrame(rows, "vault string, root string, precedence int")


def bundled(spark: SparkSession, precedence: int = 1 << 30) -> DataFrame:
    """The pages that come with the package, to be unioned last: every other source's page of a path wins."""
    rows = []
    for path, (type_, title, body) in BUNDLED.items():
        content = f"---\ntype: {type_}\ntitle: {title}\ndescription: {body.split('. ')[0]}\n---\n{body}\n"
        found = markup.parse_page(path, content.encode())
        rows.append({"vault": BUNDLE, "root": "", "precedence": precedence, "path": path, "uri": markup.uri_of(BUNDLE, path), "revision": f"sha256:{hashlib.sha256(content.encode()).hexdigest()}", **found})
    return spark.createDataFrame(rows, PAGE)


def apply_change(pages: DataFrame, root: str, vault: str, path: str, content: str, expected: str | None, digest: str) -> dict:
    """Plans again and writes the page only if the plan is the one that was agreed on."""
    plan = plan_change(pages, vault, path, content, expected)
    if plan["digest"] != digest:
        raise ValueError("the plan has changed")
    return plan | {"written": write_page(pages.sparkSession, root, path, content)}


def add_memory(pages: DataFrame, root: str, text: str, user: str, agent: str) -> str:
    """ADD with a new page of type Memory, or NOOP where this user and agent have that text."""
    digest = hashlib.sha256(text.strip().encode()).hexdigest()
    known = newest_memory(pages, user, agent).where(F.get_json_object("metadata", "$.hash") == digest)
    if not known.isEmpty():
        return "NOOP"
    first = text.strip().split("\n")[0][:120]
    fields = {"type": "Memory", "title": first, "status": "active", "user_id": user, "agent_id": agent, "hash": digest}
    head = "\n".join(f"{k}: {json.dumps(v)}" for k, v in fields.items())
    write_page(pages.sparkSession, root, f"memory/{digest[:24]}.md", f"---\n{head}\n---\n# Memory\n\n{text.strip()}\n")
    return "ADD"


def procedures(pages: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """Pages of type Procedure that a model may invoke and that have all tags, with their steps; a faulty contract fails."""
    parsed = F.udf(lambda body: (lambda r: {"steps": r[0], "problems": r[1]})(markup.procedure(body or "")), "steps array<struct<name:string,inputs:string,process:string,completion:string>>, problems array<string>", useArrow=True)
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    kept = pages.where((F.col("type") == "Procedure") & (F.get_json_object("metadata", "$.invocation") == "model") & (F.size(F.array_except(wanted, "tags")) == 0))
    found = kept.withColumn("p", parsed("body"))
    bad = F.raise_error(F.concat(F.lit("procedure "), "uri", F.lit(": "), F.array_join("p.problems", "; ")))
    return found.select("uri", "title", "tags", F.when(F.size("p.problems") == 0, F.col("p.steps")).otherwise(bad.cast("array<struct<name:string,inputs:string,process:string,completion:string>>")).alias("steps")).orderBy("uri")


def knowledge_audit(pages: DataFrame, types: tuple[str, ...] = (), tiers: tuple[str, ...] = (), entry_points: DataFrame | None = None, now: str | None = None, after: str | None = None) -> DataFrame:
    """All findings about the selected pages, in order; links are taken from all pages."""
    from quillspark.operators import audit

    links, facts = edges(pages), trust(pages)
    chosen = audit.selected(pages.join(facts.select("uri", "tier"), "uri"), types, tiers).select("uri")
    of = lambda frame: frame.join(chosen, "uri", "left_semi")
    both = links.join(chosen.withColumnRenamed("uri", "from_uri"), "from_uri", "left_semi")
    picked = of(pages)
    found = [
        audit.authored(of(marks(pages))), audit.orphans(picked, links, entry_points), audit.superseded(succession(pages), facts, chosen),
        audit.retired_references(both, facts), audit.duplicate_identities(picked), audit.tag_fragments(picked), audit.ambiguities(picked), audit.contradictions(both),
    ]
    if now and after:
        found.append(audit.stale(of(facts).withColumn("committed_at", F.lit(None).cast("string")), now, after)[0])
    return audit.ordered(*found)
