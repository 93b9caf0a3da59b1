"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

Every line is parsed once: runs of digits become the variable field <*>, and the
line goes down the tree by its number of words and its leading words to a leaf.
The templates of a leaf are grown from its lines, position by position: a word
that lines of two documents agree on at a position stays, any other word there
is a variable field.  A line whose template keeps less than Rules.agree of its
words is its own template, as is a line alone in its leaf.

A template recurs when at least two documents have it, and at least
share * documents / 2 ** (characters / halving): the more characters are fixed,
the fewer documents are needed, so short lines that meet by chance stay however
large the corpus, and long passages go from the second document on.  Its lines
stay in the first document (smallest id) and are dropped from all others.  A
document counts once for each of its lines that differ.

Lines without words, or of nothing but digits, are never dropped.  Null texts
stay null, empty texts empty; a text whose lines all go becomes empty, its row
stays.  Rows equal in id and text count as one document.  Null ids come first.
Where one id has several texts, lines stay in all of them, but in the one with
the smallest hash when no other id has the line.  All other columns are kept as
they are, whatever their names; n_chars, where there is such a column, is
counted anew for changed texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

FIELD = "<*>"
#: Leaves of several lines that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_LEAVES = 500_000


@dataclass(frozen=True)
class Rules:
    #: Leading words in a branch of the tree.
    lead: int = 3
    #: Share of a line's words that its template has to keep.
    agree: float = 0.75
    #: Share of the documents that a template without fixed characters would have to be in, and characters that halve it.
    share: float = 0.001
    halving: float = 8.0

    def least(self, documents: int, chars: Column) -> Column:
        """Documents in which a template of so many fixed characters recurs."""
        return F.greatest(F.lit(2.0), F.lit(self.share * documents) * F.pow(F.lit(2.0), -chars / F.lit(self.halving)))


def parsed(docs: DataFrame, id_col: str, text_col: str, rules: Rules) -> DataFrame:
    """(id, mark, pos, plain, chars, key, leaf) for each line; id and mark together name a document, key the line without its numbers."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    plain = F.regexp_replace(F.trim(F.regexp_replace("line", r"[ \t\r\f\x0B]+", " ")), "[0-9]+", FIELD)
    lines = lines.select("id", "mark", "pos", plain.alias("plain"))
    words = F.split("plain", " ")
    chars = F.length(F.replace(F.replace("plain", F.lit(FIELD), F.lit("")), F.lit(" "), F.lit("")))
    return lines.select("id", "mark", "pos", "plain", chars.alias("chars"), F.xxhash64("plain").alias("key"), F.xxhash64(F.size(words), F.slice(words, 1, rules.lead)).alias("leaf"))


#: What is known of the documents of a line: how many, how many of them without an id, and the ends of their ids and marks.
FACTS = ["docs", "nulls", "low", "high", "low_mark", "high_mark"]


def _facts() -> list[Column]:
    """FACTS of several lines together."""
    return [F.sum("docs").alias("docs"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_mark").alias("low_mark"), F.max("high_mark").alias("high_mark")]


def _one_id() -> Column:
    return F.col("low").isNull() | ((F.col("nulls") == 0) & (F.col("low") == F.col("high")))


def _several() -> Column:
    """Whether FACTS are of two documents at least."""
    return ~_one_id() | (F.col("low_mark") != F.col("high_mark"))


def _first() -> Column:
    """Whether a line of the document (id, mark) is one that stays."""
    same = F.when(F.col("nulls") > 0, F.col("id").isNull()).otherwise(F.coalesce(F.col("id") == F.col("low"), F.lit(False)))
    return same & (~_one_id() | (F.col("mark") == F.col("low_mark")))


def grown(scratch: Scratch, lines: DataFrame, texts: DataFrame, rules: Rules) -> DataFrame:
    """(key, template, chars, FACTS) of the lines (key, leaf, FACTS) whose leaf has others; texts: (key, leaf, plain)."""
    shared = scratch.write(lines.groupBy("leaf").agg(F.count("*").alias("lines"), *_facts()).where((F.col("lines") > 1) & _several()).select("leaf"))
    if shared.count() <= BROADCAST_LEAVES:  # else the texts of all lines are joined by a shuffle
        shared = F.broadcast(shared)
    plain = texts.join(shared, "leaf", "left_semi").groupBy("key").agg(F.any_value("plain").alias("plain"))
    rows = lines.join(shared, "leaf", "left_semi").join(plain, "key")
    words = rows.select("leaf", "key", *FACTS, F.posexplode(F.split("plain", " ")).alias("at", "word"))
    chars = F.length(F.replace("word", F.lit(FIELD), F.lit("")))
    words = words.select("leaf", "key", *FACTS, F.xxhash64("leaf", "at", "word").alias("place"), chars.alias("chars"))
    agreed = words.groupBy("place").agg(*_facts()).where(_several()).select("place", F.lit(True).alias("fixed"))
    told = words.select("leaf", "key", "place", "chars").join(agreed, "place", "left")
    fixed = lambda value: F.when(F.col("fixed"), value)
    told = told.groupBy("leaf", "key").agg(
        F.count("*").alias("size"), F.count("fixed").alias("kept"), F.coalesce(F.sum(fixed(F.col("chars"))), F.lit(0)).alias("chars"), F.bit_xor(fixed(F.col("place"))).alias("sum")
    )
    told = told.where(F.col("kept") >= F.lit(rules.agree) * F.col("size"))
    return told.select("key", F.xxhash64("leaf", "kept", "sum").alias("template"), "chars").join(lines.select("key", *FACTS), "key")


def recurring(scratch: Scratch, rows: DataFrame, rules: Rules) -> DataFrame:
    """(key, FACTS of its template's documents) of the lines that recur; rows: as from parsed()."""
    documents = rows.where("pos = 0").count()
    rows = rows.where("chars > 0")
    each = rows.select("leaf", "key", "chars", "id", "mark").distinct()
    lines = each.groupBy("leaf", "key", "chars").agg(
        F.count("*").alias("docs"), F.count_if(F.col("id").isNull()).alias("nulls"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("mark").alias("low_mark"), F.max("mark").alias("high_mark")
    )
    lines = scratch.write(lines)
    some = scratch.write(grown(scratch, lines, rows.select("key", "leaf", "plain"), rules))
    enough = _several() & (F.col("docs") >= rules.least(documents, F.col("chars")))
    templates = some.groupBy("template").agg(F.max("chars").alias("chars"), *_facts()).where(enough).select("template", *FACTS)
    by_template = some.select("key", "template").join(templates, "template").select("key", *FACTS)
    exact = lines.where(enough).select("key", *FACTS)
    return by_template.unionByName(exact.join(by_template.select("key"), "key", "left_anti"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), count_col: str | None = "n_dropped") -> DataFrame:
    """docs with the lines of recurring templates dropped from all documents but the first.

    The lines that went are counted in count_col (None: nowhere), which replaces a column of that name.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(parsed(docs, id_col, text_col, rules))
    again = rows.where("chars > 0").select("id", "mark", "pos", "key").join(recurring(scratch, rows, rules), "key").where(~_first())
    gone = again.groupBy("id", "mark").agg(F.collect_set("pos").alias("drop"))
    left, right = docs.alias("l"), gone.alias("r")
    joined = left.join(right, F.col(f"l.{id_col}").eqNullSafe(F.col("r.id")) & (F.xxhash64(F.col(f"l.{text_col}")) == F.col("r.mark")), "left")
    text, drop = F.col(f"l.`{text_col}`"), F.col("r.drop")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(drop, i)), "\n")
    changed = drop.isNotNull()
    out = {text_col: F.when(changed, kept).otherwise(text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(kept)).otherwise(F.col("l.n_chars")).cast(docs.schema["n_chars"].dataType)
    columns = [out.get(c, F.col(f"l.`{c}`")).alias(c) for c in docs.columns if c != count_col]
    counted = [] if count_col is None else [F.when(changed, F.size(drop)).otherwise(0).alias(count_col)]
    return joined.select(*columns, *counted)
