"""Markdown pages as entities, links, typed relations and section facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import let, spans, stripped

LINK = r"\[\[[^\[\]\n]*\]\]"
MAX_GAP = 80
#: Phrases between two links and the relation they state.
PATTERNS = [
    ("depends on", "depends_on"), ("depend on", "depends_on"), ("requires", "depends_on"), ("uses", "uses"),
    ("use", "uses"), ("implements", "implements"), ("extends", "extends"), ("supersedes", "supersedes"),
    ("replaces", "supersedes"), ("alternative to", "alternative_to"), ("blocks", "blocks"), ("blocked by", "blocked_by"),
    ("owns", "owns"), ("owned by", "owned_by"), ("works at", "works_at"), ("works for", "works_at"),
    ("founded by", "founded_by"), ("founded", "founded"), ("manages", "manages"), ("managed by", "managed_by"),
    ("reports to", "reports_to"), ("decided by", "decided_by"), ("documented in", "documented_in"),
    ("authored by", "authored_by"), ("invested in", "invested_in"), ("invests in", "invested_in"),
    ("advises", "advises"), ("advised by", "advised_by"), ("attended", "attended"), ("attends", "attended"),
    ("parent of", "parent_of"), ("child of", "child_of"), ("part of", "part_of"), ("contains", "contains"),
    ("related to", "related_to"), ("see also", "related_to"),
]
#: Words that begin another clause.
BREAKERS = ["and", "or", "but", "then", "so", "while", "however", "although", "yet", "because"]
#: Entity type of a page by its first folder.
FOLDERS = {"entities": "technology", "concepts": "concept", "comparisons": "comparison", "people": "person", "teams": "team"}


def link_target(raw: Column) -> Column:
    return stripped(F.element_at(F.split(F.regexp_extract(raw, r"\[\[([^\[\]\n]*)\]\]", 1), r"\|"), 1))


def links(pages: DataFrame, text: str = "content") -> DataFrame:
    """(id, line, target, display) of every ``[[target|display]]``; lines from 1."""
    rows = pages.select("id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "s"))
    rows = rows.select("id", (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("s", F.lit(LINK), F.lit(0))).alias("raw"))
    display = F.regexp_extract("raw", r"\|([^\]]*)\]\]", 1)
    rows = rows.select("id", "line", link_target(F.col("raw")).alias("target"), F.when(F.col("raw").contains("|"), stripped(display)).alias("display"))
    return rows.where("target <> ''")


def relation_of(gap: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """What the words between two links state: the longest phrase, before any
    word that begins another clause; null if there is none."""
    words = F.concat(F.lit(" "), stripped(F.regexp_replace(F.lower(gap), r"[\s!-,./:-@\[-^`{-~]+", " ")), F.lit(" "))
    free = rf"^ (?:(?!(?:{'|'.join(BREAKERS)}) )[^ ]+ )*?"
    out = F.lit(None).cast("string")
    # the last condition wraps all others, so it is tried first
    for phrase, relation in sorted(reversed(patterns), key=lambda p: len(p[0].split())):
        out = F.when(words.rlike(free + phrase + " "), F.lit(relation)).otherwise(out)
    return out


def typed_relations(pages: DataFrame, text: str = "content", patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """(id, source, relation_type, target, evidence) of neighbouring links.

    The gap has at most 80 characters and no blank line.
    """
    both = F.struct(F.split(F.col(text), LINK, -1).alias("parts"), F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(0)).alias("raws"))

    def pairs(s: Column) -> Column:
        one = lambda i: F.struct(F.get(s["raws"], i - 1).alias("a"), F.get(s["parts"], i).alias("gap"), F.get(s["raws"], i).alias("b"))
        none = F.array().cast("array<struct<a:string,gap:string,b:string>>")
        return F.when(F.size(s["raws"]) > 1, F.transform(F.sequence(F.lit(1), F.size(s["raws"]) - 1), one)).otherwise(none)

    rows = pages.select("id", F.explode(let(both, pairs)).alias("p")).select("id", "p.*")
    rows = rows.where((F.length("gap") <= MAX_GAP) & (F.length("gap") > 0) & ~F.col("gap").contains("\n\n"))
    rows = rows.withColumn("relation_type", relation_of(F.col("gap"), patterns)).where("relation_type IS NOT NULL")
    return rows.select("id", link_target(F.col("a")).alias("source"), "relation_type", link_target(F.col("b")).alias("target"), stripped(F.col("gap")).alias("evidence"))


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def field(front: Column, key: str) -> Column:
    """The value of a key on one line; null if it is missing or blank."""
    value = stripped(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.when(value != "", F.regexp_replace(value, "^[\"']|[\"']$", ""))


def list_field(front: Column, key: str) -> Column:
    """An inline list, with or without brackets, or a block list of ``- item`` lines."""
    inline = F.regexp_replace(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*)$", 1), r"^\s*\[|\]\s*$", "")
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*- .*(?:\r?\n|\z))+)", 1)
    items = F.when(block != "", F.split(F.regexp_replace(block, r"(?m)^[ \t]*- ", ""), r"\r?\n")).otherwise(F.split(inline, ","))
    clean = F.transform(items, lambda x: F.regexp_replace(stripped(x), "^[\"']+|[\"']+$", ""))
    return F.filter(clean, lambda x: x != "")


def observed(front: Column) -> Column:
    """Epoch milliseconds of observed_at, else decided_at, else date."""
    raw = F.coalesce(*[field(front, k) for k in ("observed_at", "decided_at", "date")])
    day = F.unix_date(F.try_to_date(raw, "yyyy-MM-dd")).cast("long") * 86_400_000
    return F.coalesce(F.when(F.length(raw) == 10, day), F.unix_millis(F.try_to_timestamp(raw)))


def entity_type_of(path: Column) -> Column:
    first = F.element_at(F.split(path, "/"), 1)
    return reduce(lambda out, kv: F.when(first == kv[0], kv[1]).otherwise(out), FOLDERS.items(), F.lit("unknown"))


def anchor(heading: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(heading)), r"\s+", "-")


def sections(pages: DataFrame, text: str = "content") -> DataFrame:
    """(id, pos, heading, anchor, content) of every ``##`` section, in order; what
    stands before the first one is left out."""
    marked = F.split(F.concat(F.lit("\n"), body(F.col(text))), r"\n(?=##+[ \t])", -1)
    rows = pages.select("id", F.posexplode(marked).alias("pos", "s")).where("s RLIKE '^##+[ \\t]'")
    heading = stripped(F.regexp_extract("s", r"^##+[ \t]+([^\n]*)", 1))
    rest = stripped(F.regexp_replace("s", r"^[^\n]*\n?", ""))
    return rows.select("id", "pos", heading.alias("heading"), anchor(heading).alias("anchor"), rest.alias("content"))


def page_entities(pages: DataFrame, text: str = "content") -> DataFrame:
    """One entity per page: name from its title or file name, type, tags, aliases, time."""
    front = frontmatter(F.col(text))
    title = stripped(F.regexp_extract(body(F.col(text)), r"(?m)^# +(.*)$", 1))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1)
    return pages.select(
        "id", F.when(title != "", title).otherwise(stem).alias("name"),
        F.coalesce(F.lower(field(front, "type")), entity_type_of(F.col("path"))).alias("entity_type"),
        list_field(front, "tags").alias("tags"), list_field(front, "aliases").alias("aliases"), observed(front).alias("observed_at"),
    )


def link_spans(text: Column) -> Column:
    return spans(text, LINK)
