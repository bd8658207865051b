"""Text, URL, time and triplet expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Line breaks become blanks and quotes go."""
    return F.translate(text, "\n\"'", " ")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def words(text: Column) -> Column:
    """Words of a cleaned text; an empty text has none. Quotes go, and words end at white space, so the text is passed over twice only."""
    return F.array_remove(F.split(F.regexp_replace(text, "[\"']", ""), "[ \t\r\n]+"), "")


def entity_like(word: Column) -> Column:
    """Whether the ASCII letters of a word are a capital and then small ones; a word's other characters do not count. Words that begin
    with a small letter, which most do, are told by it."""
    return ((word < "a") | (word >= "{")) & word.rlike("^[^A-Za-z]*[A-Z][^A-Z]*$")


def letters(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "")


def keep_characters(text: Column, allowed: str = "A-Za-z0-9 _.,-") -> Column:
    """Only characters of a class."""
    return F.regexp_replace(text, f"[^{allowed}]", "")


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, F.lit(2), F.length(text))))


def property_title(key: Column) -> Column:
    """snake_case to Words In Title Case."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)


def url_last_segment(url: Column) -> Column:
    """The last part of the path, else the first label of the host."""
    path = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    segment = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.when(segment != "", segment).otherwise(F.split_part(url_host(url), F.lit("."), F.lit(1)))


def video_id(url: Column) -> Column:
    """The 11 characters that name a video; null without them."""
    found = F.regexp_extract(url, "(?:v=|youtu\\.be/|embed/)([A-Za-z0-9_-]{11})", 1)
    return F.nullif(found, F.lit(""))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    """Without any folder, so that it cannot leave the one it is put in."""
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def hms(seconds: Column) -> Column:
    """Seconds as H:MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def seconds_of(text: Column) -> Column:
    """H:MM:SS or MM:SS as seconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))


def triplet(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit("-"), relation, F.lit("->"), target)


_TRIPLET = "^(.+)-([^-]+)->(.+)$"


def parse_triplet(text: Column) -> Column:
    """source, relation and target of a triplet; null where the text is not one."""
    part = lambda k: F.trim(F.regexp_extract(text, _TRIPLET, k))
    return F.when(text.rlike(_TRIPLET), F.struct(part(1).alias("source"), part(2).alias("relation"), part(3).alias("target")))


def triples_of(text: Column) -> Column:
    """A comma-separated list as triples; null if its length is not a multiple of three."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    n = F.size(parts)
    triples = F.transform(
        F.sequence(F.lit(0), F.greatest(n / 3 - 1, F.lit(0)).cast("int")),
        lambda k: F.struct(F.get(parts, k * 3).alias("source"), F.get(parts, k * 3 + 1).alias("relation"), F.get(parts, k * 3 + 2).alias("target")),
    )
    return F.when((n % 3 == 0) & (text != ""), triples)


def without_ticks(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("`"), F.lit("")))


def is_refusal(answer: Column, openings: tuple[str, ...]) -> Column:
    """Whether an answer begins as a refusal does, in either case."""
    begins = [F.lower(F.trim(answer)).startswith(x.lower()) for x in openings]
    out = F.lit(False)
    for x in begins:
        out = out | x
    return F.coalesce(out, F.lit(False))


def estimate(size: Column, per_kb: float = 0.2) -> Column:
    """Minutes and seconds that a file of so many bytes may take."""
    s = F.floor(size / 1000 * per_kb).cast("long")
    return F.struct(F.floor(s / 60).alias("minutes"), (s % 60).alias("seconds"))


def title_apart(title: Column, url: Column, n_urls: Column) -> Column:
    """The title, with the last part of the url behind it where several urls have it."""
    return F.when(n_urls > 1, F.concat(title, F.lit("-"), url_last_segment(url))).otherwise(title)


#: A web address: a scheme, and a host of two labels or more whose last is letters, before any port, path or query.
_WEB = "^https?://([^/?#:@\\s.]+[.])+[a-z]{2,}(:[0-9]+)?([/?#]|$)"
#: What urls of each other kind look like.
_VIDEO = "^(?:https?://)?(?:www\\.)?(?:youtu\\.be/|youtube\\.com/(?:embed/|v/|watch\\?v=|watch\\?.+&v=))[A-Za-z0-9_-]{11}(?:\\S+)?$"
_WIKI = "^https?://(?:www\\.)?([a-zA-Z]{2,3})\\.wikipedia\\.org/wiki/(.*)$"
_BUCKET = "^s3://([^/]+)/?$"


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_WEB), F.lit(False))


def url_kind(url: Column) -> Column:
    """video, wiki, bucket or web; null for what is none of them."""
    return F.when(url.rlike(_VIDEO), "video").when(url.rlike(_WIKI), "wiki").when(url.rlike(_BUCKET), "bucket").when(url.rlike(_WEB), "web")


def host_in(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(url_host(url).isin(*hosts), F.lit(False))


def wiki_parts(url: Column) -> Column:
    """language and page of an article's url; null for any other."""
    part = lambda k: F.regexp_extract(url, _WIKI, k)
    return F.when(url.rlike(_WIKI), F.struct(part(1).alias("language"), part(2).alias("page")))


def unquoted_name(url: Column) -> Column:
    """The last part of a path without its query, percent signs decoded."""
    return F.url_decode(F.regexp_extract(F.split_part(url, F.lit("?"), F.lit(1)), "([^/]*)$", 1))


#: Calls that an instruction must not hold.
_CALLS = ("os\\.getenv\\(", "eval\\(", "exec\\(", "subprocess\\.", "import os", "import subprocess")


def sanitize_instruction(text: Column) -> Column:
    """Braces become brackets, calls are blocked in either case, white space collapses."""
    out = F.translate(text, "{}", "[]")
    for call in _CALLS:
        out = F.regexp_replace(out, f"(?i){call}", "[BLOCKED]")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def named_property(properties: Column) -> Column:
    """The value of the first key that ends in name, title, id or description, in either case."""
    keys = F.filter(F.map_keys(properties), lambda k: k.rlike("(?i)(name|title|id|description)$"))
    return F.get(F.transform(keys, lambda k: F.element_at(properties, k)), F.lit(0))


def node_text(label: Column, name: Column, description: Column) -> Column:
    """Label:name (description)"""
    return F.concat(F.coalesce(label, F.lit("")), F.lit(":"), F.coalesce(name, F.lit("")), F.when(description.isNotNull(), F.concat(F.lit(" ("), description, F.lit(")"))).otherwise(""))


def rel_text(source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws(" ", source, kind, target)


def community_text(nodes: Column, rels: Column) -> Column:
    """What a summary is made of: a line for each of nodes (id, type, description) and of rels (start, type, end)."""
    node = lambda n: F.concat(F.lit("id: "), n.id, F.lit(", type: "), n.type, F.when(F.coalesce(n.description, F.lit("")) != "", F.concat(F.lit(", description: "), n.description)).otherwise(""), F.lit("\n"))
    rel = lambda r: F.concat(F.lit("("), r.start, F.lit(")-[:"), r.type, F.lit("]->("), r.end, F.lit(")\n"))
    lines = lambda x, f: F.array_join(F.transform(x, f), "")
    return F.concat(F.lit("Nodes are:\n"), lines(nodes, node), F.lit("\nRelationships are:\n"), lines(rels, rel))


def numbered(texts: Column) -> Column:
    """Summary 1: ... Summary 2: ..."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("Summary "), (i + 1).cast("string"), F.lit(": "), x)), " ")


def title_and_summary(text: Column, untitled: str = "Untitled Community") -> Column:
    """title and summary of a reply: of lines that begin with these words, in either case, what follows the first colon; the last such line counts."""
    lines = F.split(text, "\n")
    last = lambda word: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(lines, lambda x: F.lower(x).startswith(word))), -1)
    value = lambda line: F.trim(F.regexp_replace(line, "^[^:]*:", ""))
    return F.struct(F.coalesce(value(last("title")), F.lit(untitled)).alias("title"), F.coalesce(value(last("summary")), F.lit("")).alias("summary"))


def utc_text(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def struct_time(parts: Column) -> Column:
    """A timestamp of year, month, day, hour, minute, second."""
    return F.make_timestamp(parts.year, parts.month, parts.day, parts.hour, parts.minute, parts.second)


def json_list(text: Column) -> Column:
    """A JSON list as trimmed strings; empty where it is none."""
    return F.transform(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x))


def tagged_triplets(text: Column) -> Column:
    """Triplets of a text in which each <triplet> opens a head, each <subj> after it a tail and the <obj> after that its type.

    A part without a head, tail or type names no triplet; what stands before the first <triplet>, and padding, counts for nothing.
    """
    bare = F.regexp_replace(text, "</?s>|<pad>", "")
    cut = lambda x, mark: F.split(x, mark)
    name = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))

    def of_head(part: Column) -> Column:
        pieces = cut(part, "<subj>")
        head = name(F.get(cut(F.get(pieces, F.lit(0)), "<obj>"), F.lit(0)))
        rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.transform(rest, lambda x: F.struct(head.alias("head"), name(F.get(cut(x, "<obj>"), F.lit(1))).alias("type"), name(F.get(cut(x, "<obj>"), F.lit(0))).alias("tail")))

    parts = cut(bare, "<triplet>")
    found = F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), of_head))
    return F.filter(found, lambda x: (x.head != "") & (x.type != "") & (x.tail != ""))


def token_total(reply: Column) -> Column:
    """Tokens of a reply's metadata in JSON, whichever field its provider has; 0 where none is known."""
    field = lambda path: F.get_json_object(reply, path).cast("long")
    both = field("$.usage.input_tokens") + field("$.usage.output_tokens")
    return F.coalesce(field("$.token_usage.total_tokens"), field("$.usage_metadata.prompt_token_count"), field("$.usage.total_tokens"), both, field("$.prompt_eval_count"), F.lit(0))


def snake_words(key: Column) -> Column:
    """snake case to camelCase."""
    parts = F.split(F.lower(key), "_")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.initcap(x)), ""))


def without_blank(nodes: Column) -> Column:
    """Of nodes (id, type) those whose id and type are not blank, back-ticks taken off."""
    bare = F.transform(nodes, lambda x: F.struct(without_ticks(x.id).alias("id"), without_ticks(x.type).alias("type")))
    return F.filter(bare, lambda x: (F.coalesce(x.id, F.lit("")) != "") & (F.coalesce(x.type, F.lit("")) != ""))


#: Entities of markup that pages use most, the mark itself last.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, character in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text
