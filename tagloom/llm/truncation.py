"""Problem 8: texts that were cut off.

First the prefix self-join: a text is cut when it is, without closing dots, a strict prefix of a longer copy that goes
on in the same line.  Every text sends hashes of its prefixes of 1, 4, 16, ... characters; a group of equal hashes counts
when it holds two different texts, one of them shorter than four times that prefix.  The texts of such groups are sorted over
the cluster, and a text is a strict prefix of some other exactly when it is one of its successor in that order.

Where no longer copy was kept (most cuts in practice), the end of the text decides, against statistics of all texts:

* a broken character, a table row without its last bar, an answer whose braces never close;
* a last line without a closing mark, in a source that does set them.  A source that never sets one is told from a source
  with a field limit by the lengths of its open texts: those of a field limit pile up below one size in characters or
  bytes.  In a source without marks only an end inside a word or on a word that sentences do not end with counts: one
  that stands inside texts less often than at their end, or that hardly ever stands before a closing mark.  Numbers, and
  words of scripts that set no blanks between words, are not judged so;
* dots after the end, unless the phrase before them is a usual way to end (a share of ``USUAL_SHARE`` of all texts that
  end in dots).

A last line without a mark, below other lines, is whole where its layout is one that texts do end with.  The layout of a line is its marks,
with words and numbers as classes; a layout ends texts when it is one of lists (mostly found inside texts, and a share of
``LIST_SHARE`` of its uses at an end) or a closing formula (``FORMULA_SHARE`` of all unmarked ends, by two standard
errors).  A label before a colon that stands before the last line more often than in it is a question without its answer.
Bullets and signatures are known by their typographic mark.

All statistics are over distinct texts, so a text repeated under many ids weighs as one; the verdict goes back to each of
its ids.  Whole texts and whole last lines are looked at.

Defined cases: null, empty and blank texts are never cut; a null source is a source of its own; repeated texts are cases
under each id; texts that differ in blanks around line breaks only are one for the self-join; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.bitmaps import hash_filter
from tagloom.plans.staging import stage, table

USUAL_SHARE = 0.05
#: A source with at least so many open texts and no closed one among its running texts sets no marks ...
UNMARKED_LEAST, UNMARKED_SHARE = 3, 0.03
#: ... unless this share of its open texts lies within ``NEAR`` of the longest of them.
PILED_SHARE, NEAR = 0.5, 24
#: A word may end texts if at least this share of its texts has it inside ...
INSIDE_LEAST = 0.5
#: ... and it stands before a closing mark in more than this share of them (by the rule of three, so rare words may).
CLOSING_LEAST = 0.001
#: Layouts of lists stand inside texts in this share of their uses, and at an end in this one.
INNER_SHARE, LIST_SHARE = 0.5, 0.03
FORMULA_SHARE = 0.01

#: Bits of the table of words that are looked for.
WORD_BITS = 1 << 16
#: Bits of the table of documents whose texts are sorted.
DOC_BITS = 1 << 22
#: Texts are sent to their place in the sort by a prefix that so many documents share at most.
HOT_ROWS = 1000

_BLANKS = " \t\n\r\f\v\u00a0\u2003\u200b\u3000\ufeff"
#: Marks that close a sentence, and what may follow them.
_CLOSED = r"[.!?。！？‽؟۔।][\"'”’»)\]」』*_\s\p{So}‍️]*$"
_DOTS = r"(?:\.{3,}|…)[\s\])]*$"
_WORD = r"[\p{L}\p{N}]+"
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_BROKEN = "\ufffd"
#: Typographic marks of last lines that are whole: a bullet or a list number, the dash of a signature.
_BULLET = r"^\s*(?:[-*•·]|\d+[.)])\s"
_SIGNED = r"^\s*(?:—|–|--)\s*[^\s-]"
_LABEL = r"^\s*(\p{Lu}[\p{L} ]{2,24}):\s+\S+"


def _trimmed(text: Column, more: str = "") -> Column:
    return F.rtrim(text, F.lit(_BLANKS + more))


def _hashes(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def layout(line: Column) -> Column:
    """A line with its words and numbers as classes, repeats once, without blanks."""
    for pattern, put in ((r"\p{Lu}[\p{L}\p{M}'’]*", "A"), (r"\p{Ll}[\p{L}\p{M}'’]*", "a"), (r"\p{Lo}[\p{L}\p{M}]*", "o"), (r"\p{N}+", "9"), (r"\s+", ""), (r"(.)\1+", "$1")):
        line = F.regexp_replace(line, pattern, put)
    return line


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the end of each text that is not blank says; ``line`` is the kind of a last line that its layout decides."""
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), _trimmed(F.col(text)).alias("whole"),
    ).where("whole <> ''")
    rows = rows.select(
        "doc_id", "source", "chars", "bytes", *_hashes("whole"), F.substring_index("whole", "\n", -1).alias("line"),
        F.substring_index(F.substring_index("whole", "\n", -2), "\n", 1).alias("before"), F.split("whole", "\n").alias("lines"),
    )
    line = F.col("line")
    bare = _trimmed(line, f".\u2026{_BROKEN}")
    is_table = line.rlike(r"^\s*\|")
    braces = F.length(line) - F.length(F.translate(line, "{", "")) - (F.length(line) - F.length(F.translate(line, "}", "")))
    has_brace = F.contains(line, F.lit("{"))
    kind = (
        F.when(F.endswith("line", F.lit(_BROKEN)), "broken")
        .when(is_table, F.when(line.rlike(r"\|\s*$"), "whole").otherwise("broken"))
        .when(has_brace & (braces != 0), "broken")
        .when(has_brace & F.endswith(line, F.lit("}")), "whole")
        .when(line.rlike(_DOTS), "dots")
        .when(line.rlike(_CLOSED), "closed")
        .when(line.rlike(_BULLET) | line.rlike(_SIGNED), "whole")
        .when(F.size("lines") == 1, "open")
        .otherwise("line")
    )
    label = lambda c: F.regexp_extract(c, _LABEL, 1)
    inner = F.filter(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x: (F.trim(x) != "") & ~x.rlike(_CLOSED))
    # the last three words; from the end, so that the pattern is tried at one place
    tail = F.reverse(F.regexp_extract(F.reverse(bare), r"^[^\p{L}\p{N}]*+((?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){0,2}+[\p{L}\p{N}]*+)", 1))
    rows = rows.select("*", kind.alias("kind"), tail.alias("three"), bare.rlike(r"[,;:(–—&/-]\s*$").alias("hangs"))
    phrase = F.trim(F.regexp_replace("three", r"[^\p{L}\p{N}]+", " "))
    return rows.select(
        "doc_id", "source", "h1", "h2", "chars", "bytes", "kind", "hangs",
        F.when(F.col("three") != "", F.substring_index(phrase, " ", -1)).alias("word"), F.when(F.col("kind") == "dots", phrase).alias("phrase"),
        label(line).alias("label"), label(F.col("before")).alias("label_before"),
        F.when(F.col("kind") == "line", F.xxhash64(layout(line))).alias("layout"), F.array_distinct(F.transform(inner, lambda x: F.xxhash64(layout(x)))).alias("inner"),
    )


def distinct_texts(ends: DataFrame) -> DataFrame:
    """The ends without ids, each text once in a source; texts that differ in blanks at the end are one."""
    rest = [c for c in ends.columns if c not in ("doc_id", "chars", "bytes", *KEY)]
    return ends.groupBy(*KEY).agg(F.max("chars").alias("chars"), F.max("bytes").alias("bytes"), *[F.first(c).alias(c) for c in rest])


def source_styles(ends: DataFrame) -> DataFrame:
    """(source, unmarked): whether a source sets no closing marks, of distinct texts."""
    is_open, closed = F.col("kind") == "open", F.col("kind") == "closed"
    per = ends.groupBy("source").agg(
        F.count_if(is_open).alias("n_open"), F.count_if(closed).alias("n_closed"),
        F.max(F.when(is_open, F.col("chars"))).alias("most_chars"), F.max(F.when(is_open, F.col("bytes"))).alias("most_bytes"),
    )
    # only the sources without marks are looked at again
    some = per.where((F.col("n_open") >= UNMARKED_LEAST) & (F.col("n_closed") <= UNMARKED_SHARE * F.col("n_open")))
    piled = (
        ends.where(is_open).join(some, "source").groupBy("source")
        .agg((F.greatest(F.avg((F.col("chars") > F.col("most_chars") - NEAR).cast("int")), F.avg((F.col("bytes") > F.col("most_bytes") - NEAR).cast("int")))).alias("piled"))
    )
    return piled.where(F.col("piled") < PILED_SHARE).select("source", F.lit(True).alias("unmarked"))


def _more(n: Column) -> Column:
    """A number of cases less two standard errors."""
    return n - 2 * F.sqrt(n)


def closing_layouts(texts: DataFrame) -> DataFrame:
    """(layout) of the lines that texts end with although they are no sentence; texts: distinct ones."""
    last = texts.where("kind = 'line'").select("layout", F.lit(0).alias("inside"), F.lit(1).alias("end"))
    uses = texts.select(F.explode("inner").alias("layout"), F.lit(1).alias("inside"), F.lit(0).alias("end")).unionByName(last)
    per = uses.groupBy("layout").agg(F.sum("inside").alias("inside"), F.sum("end").alias("end")).where("end > 0")
    total = last.agg(F.count(F.lit(1)).alias("ends")).withColumn("_one", F.lit(1))
    n, inside, end = F.col("inside") + F.col("end"), F.col("inside"), F.col("end")
    is_list = (inside >= INNER_SHARE * n) & (end >= LIST_SHARE * n)
    is_formula = (inside < INNER_SHARE * n) & (_more(end) >= FORMULA_SHARE * F.col("ends"))
    return per.withColumn("_one", F.lit(1)).join(total, "_one").where(is_list | is_formula).select("layout")


def label_uses(texts: DataFrame) -> DataFrame:
    """(label, asks, answers): whether a label stands more often one line before the end than in the last line, or clearly less often."""
    labelled = texts.where("label <> '' or label_before <> ''")
    uses = labelled.select(F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("n")), F.struct(F.col("label_before").alias("l"), F.lit(-1).alias("n")))).alias("u"))
    per = uses.where("u.l <> ''").groupBy(F.col("u.l").alias("label")).agg(F.sum("u.n").alias("more"), F.count(F.lit(1)).alias("n"))
    return per.select("label", (F.col("more") < 0).alias("asks"), (F.col("more") > 2 * F.sqrt("n")).alias("answers"))


def with_lines_decided(texts: DataFrame) -> DataFrame:
    """The distinct texts with the kind ``line`` decided: ``whole`` or ``open``."""
    once = texts.select("h1", "h2", "kind", "label", "label_before", "layout", "inner").dropDuplicates(["h1", "h2"])
    once = stage(once.where("kind = 'line' or label <> '' or label_before <> '' or size(inner) > 0").drop("h1", "h2"), "p8-once")
    lines = texts.where("kind = 'line'")
    # a line without a label gets a key of its own, so that no key is hot
    key = F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit("#"), F.col("h1").cast("string")))
    lines = lines.withColumn("_label", key).join(label_uses(once).withColumnRenamed("label", "_label"), "_label", "left")
    lines = lines.join(closing_layouts(once).withColumn("closes", F.lit(True)), "layout", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(yes("asks"), "open").when(yes("closes") | yes("answers"), "whole").otherwise("open")
    columns = [c for c in texts.columns if c not in ("label", "label_before", "layout", "inner")]
    return texts.where("kind <> 'line'").select(*columns).unionByName(lines.withColumn("kind", kind).select(*columns))


KEY = ["source", "h1", "h2"]


#: A word with the closing mark behind it, if there is one.
_MARKED = r"[\p{L}\p{N}]++(?:[\"'”’»)\]」』]*+[.!?。！？])?"
_MARKS = "\"'”’»)]」』.!?。！？"


def word_places(docs: DataFrame, ends: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """(word, n_ends, n_inside, n_closing) of the words asked for: the distinct texts that end with it, that have it before
    their end, and that have it before a closing mark.  No text is moved: a bitmap of fixed size keeps most other words out of
    the explosion, the join with the words is exact, and repeated texts are told by their hash."""
    n_ends = ends.select("h1", "h2", "word").distinct().join(words, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n_ends"))
    may = hash_filter(words, "word", WORD_BITS)
    word = lambda w: F.rtrim(w, F.lit(_MARKS))
    rows = docs.select(_trimmed(F.col(text)).alias("whole")).where("whole <> ''").select(_hashes("whole")[0], F.regexp_extract_all("whole", F.lit(_MARKED), F.lit(0)).alias("w"))
    kept = F.filter(F.array_distinct(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))), lambda w: may(word(w)))
    rows = rows.select("h1", kept.alias("inside"), F.filter(F.slice("w", F.greatest(F.size("w"), F.lit(1)), F.lit(1)), lambda w: may(word(w))).alias("last"))
    marked = lambda w: F.length(w) > F.length(word(w))
    tagged = lambda a, c: F.transform(a, lambda w: F.struct(word(w).alias("word"), F.lit(c).alias("closing")))
    uses = F.concat(tagged(F.col("inside"), False), tagged(F.filter(F.concat("inside", "last"), marked), True))
    # the outer form, for the inner one puts a filter with a copy of the whole expression below the projection
    uses = rows.select("h1", F.explode_outer(uses).alias("u")).where("u is not null").select("h1", "u.*")
    n_uses = uses.join(words, "word", "left_semi").distinct().groupBy("word").agg(F.count_if(~F.col("closing")).alias("n_inside"), F.count_if("closing").alias("n_closing"))
    # the bitmap is a literal of this plan, and the driver makes a text of a plan at each of its steps: none of the later ones has it
    n_uses = stage(n_uses, "p8-places")
    return n_ends.join(n_uses, "word", "left").na.fill(0, ["n_inside", "n_closing"])


def cut_by_ending(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, h1, h2) of the distinct texts whose end shows a cut."""
    dots = ends.where(F.col("kind") == "dots")
    phrases = dots.select("h1", "h2", "phrase").distinct()
    total = phrases.agg(F.count(F.lit(1)).alias("n_dots")).withColumn("_one", F.lit(1))
    usual = (
        phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)).join(total, "_one")
        .where((F.col("n") >= 2) & (F.col("n") >= USUAL_SHARE * F.col("n_dots")))
        .select("phrase", F.lit(True).alias("usual"))
    )
    opened = stage(ends.where(F.col("kind") == "open").join(source_styles(ends), "source", "left"), "p8-open")
    odd = F.col("hangs")
    shown = (
        ends.where(F.col("kind") == "broken").select(*KEY)
        .unionByName(dots.join(usual, "phrase", "left").where(F.col("usual").isNull()).select(*KEY))
        .unionByName(opened.where(F.col("unmarked").isNull() | odd).select(*KEY))
    )
    # only the last words in sources without marks are looked for in the texts
    unsure = opened.where(F.col("unmarked") & ~odd & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").rlike(_UNSPACED))
    words = stage(unsure.select("word").distinct(), "p8-words")
    if words.isEmpty():
        return shown
    inside, closing = F.col("n_inside"), F.col("n_closing") + 3
    fragment = (inside < INSIDE_LEAST * (inside + F.col("n_ends"))) | (closing < CLOSING_LEAST * inside)
    return shown.unionByName(unsure.join(word_places(docs, ends, words).where(fragment), "word", "left_semi").select(*KEY))


# ---------------------------------------------------------------- prefix self-join

MARKS = "b1 long, b2 long, inline boolean, part int, role string, text string"
#: Stands for a line break; it sorts last, so a copy that goes on in the same line comes first.
BREAK = "\U0010ffff"
_LINE_BREAK = r"(?<![ \t])[ \t]*+\n\s*+"


def _mark(role: str, part: int, keys: list, texts: list, inline: list) -> pd.DataFrame:
    b1, b2 = zip(*keys) if keys else ((), ())
    return pd.DataFrame({"b1": pd.Series(b1, dtype="object"), "b2": pd.Series(b2, dtype="object"), "inline": pd.Series(inline, dtype="object"), "part": part, "role": role, "text": pd.Series(texts, dtype="object")})


def _strict_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted texts: ``found``, the ones that are a strict prefix of the next; ``head`` and ``tail`` of the partition."""
    part = TaskContext.get().partitionId()
    text, key = None, None
    for b in batches:
        found, inline = [], []
        for k, t in zip(zip(b["b1"], b["b2"]), b["text"]):
            if text is None:
                yield _mark("head", part, [k], [t], [None])
            elif t.startswith(text) and t != text:
                found.append(key)
                inline.append(t[len(text)] != BREAK)
            text, key = t, k
        yield _mark("found", part, found, [None] * len(found), inline)
    if text is not None:
        yield _mark("tail", part, [key], [text], [None])


def _bare(text: str) -> Column:
    return _trimmed(F.col(text), f".\u2026{_BROKEN}")


def prefix_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, b1, b2, prefixes): two hashes of the text without closing dots, and those of its first 1, 4, 16, ... characters."""
    rows = docs.select(F.col(key).alias("doc_id"), F.regexp_replace(_bare(text), _LINE_BREAK, BREAK).alias("text")).where("text <> ''")
    steps = F.sequence(F.lit(0), F.floor((F.length(F.bin(F.length("text"))) - 1) / 2).cast("int"))
    prefixes = F.transform(steps, lambda k: F.xxhash64(k, F.left(F.col("text"), F.pow(F.lit(4), k).cast("int"))))
    return rows.select("doc_id", F.xxhash64("text").alias("b1"), F.xxhash64(F.lit(1), "text").alias("b2"), prefixes.alias("prefixes"))


def prefix_of_longer(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, inline) of the texts that, without closing dots, are a strict prefix of another text; ``inline``: a copy goes on in the same line.

    Only numbers are shuffled to find the groups; of the texts in groups each distinct one goes through the sort once.  The driver
    draws a sample of what the ranges of the sort are of; so these are of prefixes that tell the texts apart well enough, and not
    of whole texts.
    """
    keys = stage(prefix_keys(docs, key, text), "p8-prefix-keys")
    each = keys.select("doc_id", "b1", "b2", F.size("prefixes").alias("n"), F.posexplode_outer("prefixes").alias("k", "h"))
    groups = each.groupBy("h").agg(F.min("b1").alias("a"), F.max("b1").alias("z"), F.max(F.col("k") == F.col("n") - 1).alias("own"), F.count(F.lit(1)).alias("docs"))
    groups = groups.select("h", F.expr("a <> z and own").alias("counts"), (F.col("docs") > HOT_ROWS).alias("hot")).where("counts or hot")
    # hot prefixes are the first ones of a text; its texts are all that share the next one, so ranges of these are ranges of texts
    step = F.coalesce(F.max(F.when(F.col("hot"), F.col("k"))) + 1, F.lit(0))
    chosen = each.join(groups, "h").groupBy("b1", "b2").agg(F.min("doc_id").alias("doc_id"), step.alias("step"), F.max("counts").alias("counts"))
    chosen = stage(chosen.where("counts").drop("counts"), "p8-chosen")
    may = hash_filter(chosen, "doc_id", DOC_BITS, stored=True)
    texts = docs.where(may(F.col(key))).select(F.col(key).alias("doc_id"), F.regexp_replace(_bare(text), _LINE_BREAK, BREAK).alias("text")).where("text <> ''")
    texts = stage(texts.join(chosen, "doc_id").select("b1", "b2", "text", "step"), "p8-texts")
    start = F.left(F.col("text"), F.pow(F.lit(4), F.least("step", F.lit(15))).cast("int"))
    ordered = texts.withColumn("start", start).repartitionByRange("start").sortWithinPartitions("text")
    marks = stage(ordered.select("b1", "b2", "text").mapInPandas(_strict_prefixes, MARKS), "p8-prefixes")
    # the last text of a partition against the first one of the next: two rows for each partition
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    edges = marks.where("role in ('head', 'tail')").groupBy("part").agg(of("head", "text").alias("head"), of("tail", "text").alias("tail"), of("tail", "b1").alias("b1"), of("tail", "b2").alias("b2"))
    after = edges.withColumn("next", F.lead("head").over(Window.orderBy("part"))).where(F.startswith("next", "tail") & (F.col("next") != F.col("tail")))
    after = after.select("b1", "b2", (F.substring("next", F.length("tail") + 1, F.lit(1)) != BREAK).alias("inline"))
    found = marks.where("role = 'found'").select("b1", "b2", "inline").unionByName(after)
    return keys.select("doc_id", "b1", "b2").join(found, ["b1", "b2"]).select("doc_id", "inline")


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, by_prefix, by_end) of the texts that were cut off, and what shows it: a longer copy, the end of the text."""
    ends = stage(described(docs), "p8-ends")
    # read several times, so it is written before: each reading would bring the texts together anew
    texts = stage(with_lines_decided(stage(distinct_texts(ends), "p8-distinct")), "p8-kinds")
    ids = ends.select("doc_id", *KEY)
    longer = prefix_of_longer(docs).where("inline").select("doc_id").distinct()
    unfinished = ids.join(longer, "doc_id", "left_semi").join(texts.where("kind <> 'closed'"), KEY, "left_semi")
    shown = ids.join(cut_by_ending(docs, texts), KEY, "left_semi")
    both = unfinished.select("doc_id", F.lit(True).alias("by_prefix"), F.lit(False).alias("by_end")).unionByName(shown.select("doc_id", F.lit(False).alias("by_prefix"), F.lit(True).alias("by_end")))
    return both.groupBy("doc_id").agg(F.max("by_prefix").alias("by_prefix"), F.max("by_end").alias("by_end"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents whose text was cut."""
    return truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, cut, cut_share, by_prefix, by_end) of each source; blank texts count as documents.  ``by_prefix``
    and ``by_end`` tell how many of the cut texts each way shows."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select("doc_id", "source").join(truncated(docs).withColumn("cut", F.lit(1)), "doc_id", "left").groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("cut", F.lit(0))).alias("cut"), F.count_if("by_prefix").alias("by_prefix"), F.count_if("by_end").alias("by_end"))
        .withColumn("cut_share", F.round(F.col("cut") / F.col("documents"), 6))
    )
