"""Operator 1: line dedup by log templates.

Lines are parsed by a tree of fixed depth: first by their number of tokens, then by their ``LEADING``
first tokens. Tokens with a digit are variable and read as ``<*>`` from the start. Within a leaf of the
tree a token is constant at its place if lines with it occur ``MIN_DOCUMENTS`` times or more there; the
other places are variable fields and generalised too. A template must keep at least ``SIMILARITY`` of its
tokens constant, otherwise the line stands for itself: masked only, or as it is if it is mostly digits.

A template that occurs in ``MIN_DOCUMENTS`` documents or more is recurring. Its lines are dropped from
all documents but the first (the smallest doc_id); of generalised lines the values of their variable fields go
with them. Blank lines
stay, white space around and between tokens does not matter, and kept lines are returned as they were.

A null text stays null and has no lines; an empty text is one blank line. Rows with one doc_id are one
document; null ids count together as one document and are the first only if there is no other.

``Options(levels=True)`` makes this hold at any size of the table: a token is then constant at each
``level`` of support in turn (``MIN_DOCUMENTS`` documents, ``STEP`` times as many, and so on, as far as the
leaf goes), every level gives the line a template, and the line is recurring if one of them is. So a
variable field is generalised although each of its values is frequent by itself, however many other lines
share the leaf. Support then counts the documents of a line, not its occurrences.

``Options(long_tokens=n)`` lets lines of n tokens or more, with no more than their digits masked, recur from
two documents on; shorter lines and generalised ones still need ``MIN_DOCUMENTS``, which protects clean text.

``classes`` (doc_id, text_key, component_id) makes the documents of a class count as one: a line recurs only if
several classes have it, and all documents of the first class keep it, so that near copies stay as alike as
they are. Without it a copy loses the long lines that it shares.

Long texts and lines are read whole. Columns but ``text`` pass through,
except that ``n_lines`` and ``n_dropped`` replace columns of these names. An empty table gives no rows.

Only DataFrame functions are used. Lines travel as digests; a hot line or template is counted before it
is moved, and joins of a hot line have one row of it on the other side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import packed, small, stored, unpacked

WILDCARD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"
LEADING = 3
SIMILARITY = 0.7
MIN_DOCUMENTS = 5
STEP = 4  # from one level of support to the next
BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class Options:
    leading: int = LEADING
    similarity: float = SIMILARITY
    min_documents: int = MIN_DOCUMENTS
    levels: bool = False
    long_tokens: int | None = None

    @property
    def long_documents(self) -> int:
        return min(2, self.min_documents)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _tokens(line: Column) -> Column:
    """How many tokens a normalised line has."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _text_key() -> Column:
    return digest(F.col("text"))


def parsed(docs: DataFrame, options: Options) -> DataFrame:
    """doc_id, text_key, pos and masked line of every line that is not blank."""
    # Runs of white space become one space; most lines have no other than single spaces.
    uneven = reduce(or_, (F.contains("line", F.lit(c)) for c in ("  ", "\t", "\v", "\f", "\r")))
    plain = F.trim(F.when(uneven, F.regexp_replace("line", SPACE, " ")).otherwise(F.col("line")))
    # A token with a digit; the look-behind and the possessive runs keep this linear in any line.
    masked = F.regexp_replace("plain", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILDCARD)
    variable = (F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(WILDCARD), F.lit("")))) / len(WILDCARD)
    usable = _tokens(F.col("masked")) - variable >= options.similarity * _tokens(F.col("masked"))
    return (
        docs.where("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")  # once a document
        .select("doc_id", "text_key", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .where(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")))
        .select("doc_id", "text_key", "pos", plain.alias("plain"))
        .select("doc_id", "text_key", "pos", "plain", F.when(F.rlike("plain", F.lit("[0-9]")), masked).alias("masked"))
        .select("doc_id", "text_key", "pos", F.when(F.col("masked").isNotNull() & usable, F.col("masked")).otherwise(F.col("plain")).alias("line"))
    )


def _leaf(options: Options) -> Column:
    return digest(F.concat_ws(" ", _tokens(F.col("line")), F.substring_index("line", " ", options.leading)))


def _sized(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if small(frame, BROADCAST_ROWS) else frame


def _templates(options: Options) -> Column:
    """Templates of a line at all levels, from its ``tokens`` (at, token, n); n is null if the token is variable."""
    most = F.coalesce(F.array_max(F.transform("tokens", lambda t: t["n"])), F.lit(0))
    levels = F.filter(F.array(*(F.lit(options.min_documents * STEP**k).cast("long") for k in range(20))), lambda level: level <= most)

    def template(level: Column) -> Column:
        named = F.transform("tokens", lambda t: F.when(t["n"] >= level, t["token"]).otherwise(F.lit(WILDCARD)))
        constants = F.size(F.filter("tokens", lambda t: t["n"] >= level))
        return F.when(constants >= options.similarity * F.size("tokens"), digest(F.array_join(named, " ")))

    return F.array_distinct(F.filter(F.transform(levels, template), lambda t: t.isNotNull()))


def generalised(docs: DataFrame, candidates: DataFrame, options: Options) -> DataFrame:
    """line_key and template of the lines that share a leaf with others; with levels, a row for each template."""
    shared = candidates.where("kinds > 1").select("line_key", "leaf", "n")
    texts = (
        parsed(docs, options)
        .select(digest(F.col("line")).alias("line_key"), "line")
        .join(_sized(shared.select("line_key")), "line_key")
        .groupBy("line_key")
        .agg(F.any_value("line").alias("line"))
    )
    tokens = stored(
        texts.join(shared, "line_key").select("leaf", "line_key", "n", F.posexplode(F.split("line", " ")).alias("at", "token")),
        "line-tokens",
    )
    constant = (
        tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= options.min_documents)
    ).where(F.col("token") != WILDCARD)
    if options.levels:
        return (
            tokens.drop("n")
            .join(constant, ["leaf", "at", "token"], "left")
            .groupBy("line_key")
            .agg(F.sort_array(F.collect_list(F.struct("at", "token", "n"))).alias("tokens"))
            .select("line_key", F.explode(_templates(options)).alias("template"))
        )
    constant = constant.select("leaf", "at", "token", F.lit(True).alias("constant"))
    named = F.when(F.col("constant"), F.col("token")).otherwise(F.lit(WILDCARD))
    return (
        tokens.join(constant, ["leaf", "at", "token"], "left")
        .groupBy("line_key")
        .agg(
            F.sort_array(F.collect_list(F.struct("at", named.alias("token")))).alias("tokens"),
            F.count("constant").alias("constants"),
        )
        .where(F.col("constants") >= options.similarity * F.size("tokens"))
        .select("line_key", digest(F.concat_ws(" ", F.col("tokens.token"))).alias("template"))
    )


def recurring_lines(docs: DataFrame, options: Options = Options(), classes: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key and ``dropped``: a flag for each line up to the last that goes."""
    line = F.col("line")
    owner = F.col("doc_id").alias("owner")
    is_long = [] if options.long_tokens is None else [(_tokens(line) >= options.long_tokens).alias("long")]
    lines = parsed(docs, options).select(
        "doc_id", "text_key", "pos", digest(line).alias("line_key"), _leaf(options).alias("leaf"), *is_long
    )
    if classes is not None:
        named = classes.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("component_id").alias("owner"))
        named = _sized(stored(named.distinct(), "line-owners"))
        lines = lines.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text"))).drop("_id", "_text")
    lines = stored(lines if classes is not None else lines.withColumn("owner", owner), "lines")
    groups = ["leaf", "line_key", *(["long"] if is_long else [])]
    kinds = (lines.select("owner", *groups).distinct() if options.levels else lines).groupBy(*groups).agg(F.count("*").alias("n"))
    if options.levels or is_long:
        kinds = stored(kinds, "line-kinds")
    leaves = (
        kinds.groupBy("leaf")
        .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        .where(F.col("total") >= options.min_documents)
    )
    candidates = stored(kinds.join(leaves, "leaf").select("line_key", "leaf", "n", "kinds"), "line-candidates")
    templates = candidates.join(generalised(docs, candidates, options), "line_key", "left").select(
        "line_key", F.coalesce("template", "line_key").alias("template"), F.lit(options.min_documents).alias("needed")
    )
    if is_long:
        own = kinds.where(F.col("long") & (F.col("n") >= options.long_documents))
        templates = templates.union(own.select("line_key", "line_key", F.lit(options.long_documents)))
    found = stored(
        lines.join(_sized(stored(templates, "line-templates")), "line_key").select("doc_id", "text_key", "pos", "owner", "template", "needed"),
        "template-lines",
    )
    recurring = (
        found.groupBy("template", "needed")
        .agg(
            (F.count_distinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("documents"),
            F.min("owner").alias("first"),
        )
        .where(F.col("documents") >= F.col("needed"))
        .select("template", "needed", "first")
    )
    positions = F.sort_array(F.collect_set("pos"))
    dropped = (
        found.join(_sized(stored(recurring, "recurring-templates")), ["template", "needed"])
        .where(~F.col("owner").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_key")
        .agg(positions.alias("positions"))
    )
    before = F.concat(F.array(F.lit(-1)), F.slice("positions", 1, F.size("positions") - 1))
    flags = F.flatten(
        F.zip_with("positions", before, lambda at, last: F.array_append(F.array_repeat(F.lit(False), at - last - 1), F.lit(True)))
    )
    return stored(dropped.select("doc_id", "text_key", flags.alias("dropped")), "dropped-lines")


def without_recurring_lines(docs: DataFrame, options: Options = Options(), classes: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with the remaining text, and ``n_lines`` and ``n_dropped`` added."""
    marks = recurring_lines(docs, options, classes)
    marks = marks.select(F.struct(*(F.col(c) for c in marks.columns)).alias("_marks"))
    dropped = F.col("_marks.dropped")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda line, at: ~F.coalesce(F.get(dropped, at), F.lit(False)))
    rest = F.when(dropped.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    same = F.col("_key").eqNullSafe(F.col("_marks.text_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_marks.doc_id"))
    joined = packed(docs, "doc_id", "text").withColumn("_key", _text_key()).join(marks.hint("merge"), same, "left")
    added = {
        "text": rest,
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size(F.filter(dropped, lambda gone: gone)), F.lit(0)).cast("long"),
    }
    return unpacked(joined, docs.columns, added)
