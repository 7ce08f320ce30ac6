"""Column functions over BIO tag arrays.  Nothing here shuffles or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed tag domain and its ids.
TAGS = ("O", "B-PER", "I-PER", "B-EMAIL", "I-EMAIL")
LABEL_IDS = {"O": 0, "B-PER": 1, "I-PER": 2, "B-EMAIL": 3, "I-EMAIL": 4}
IGNORED = -100
SPAN = "array<struct<s:int,e:int,label:string>>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(a: Column | str, kind: str = "array<string>") -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(col(a), F.array().cast(kind))


def first_present(*arrays: Column | str) -> Column:
    """The first array that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.when(F.size(col(a)) > 0, col(a)) for a in arrays], F.array().cast("array<string>"))


def known_tags() -> Column:
    return F.array(*[F.lit(t) for t in TAGS])


def entity(tag: Column) -> Column:
    """The type of a tag, null for ``O``."""
    return F.when(tag.rlike("^[BI]-"), F.substring(tag, 3, 1_000_000))


def previous(tags: Column, i: Column) -> Column:
    return F.when(i > 0, F.get(tags, i - 1))


def is_orphan(tags: Column, tag: Column, i: Column) -> Column:
    """Whether ``I-X`` at ``i`` follows neither ``B-X`` nor ``I-X``."""
    return tag.startswith("I-") & ~F.coalesce(entity(previous(tags, i)).eqNullSafe(entity(tag)), F.lit(False))


def repair(tags: Column | str) -> Column:
    """Orphans become ``B-X``.  A repair never changes a type, so looking one tag back is enough."""
    tags = present(tags)
    return F.transform(tags, lambda t, i: F.when(is_orphan(tags, t, i), F.concat(F.lit("B-"), entity(t))).otherwise(t))


def orphans(tags: Column | str) -> Column:
    """Positions of the orphans."""
    tags = present(tags)
    return F.filter(F.transform(tags, lambda t, i: F.when(is_orphan(tags, t, i), i)), lambda i: i.isNotNull())


def is_valid_bio(tags: Column | str) -> Column:
    return F.size(orphans(tags)) == 0


def count_spans(tags: Column | str, kind: str) -> Column:
    return F.size(F.filter(present(tags), lambda t: t == F.lit(f"B-{kind}")))


def density_bucket(n: Column) -> Column:
    return F.when(n == 0, "zero_per").when(n == 1, "one_per").otherwise("multi_per")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; an expression used inside lambdas is else evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(tags: Column | str) -> Column:
    """``B-X (I-X)*`` as (s, e, label), e exclusive; orphan ``I-`` belong to no span; null tags have none."""
    return let(present(tags), _spans)


def _spans(tags: Column) -> Column:
    """Linear in the row: a span runs from a ``B-`` to the next place where no ``I-`` goes on with the type before it."""
    goes_on = lambda t, i: F.coalesce(t.startswith("I-") & (entity(previous(tags, i)) == entity(t)), F.lit(False))
    breaks = F.filter(F.transform(tags, lambda t, i: F.when(~goes_on(t, i), i)), lambda i: i.isNotNull())

    def between(at: Column) -> Column:
        each = F.transform(at, lambda i, k: F.struct(i.alias("s"), F.coalesce(F.get(at, k + 1), F.size(tags)).alias("e"), F.get(tags, i).alias("t")))
        return F.transform(F.filter(each, lambda x: x["t"].startswith("B-")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), entity(x["t"]).alias("label")))

    return let(breaks, between).cast(SPAN)


def loose_spans(tags: Column | str) -> Column:
    """Spans that an orphan ``I-X`` may open too."""
    return spans(repair(tags))


def late_spans(tags: Column | str, kind: str) -> Column:
    """Spans that only ``O``, a ``B-`` of another type or the end closes; a second ``B-X`` before that discards the first."""
    return let(present(tags), lambda t: _late_spans(t, kind))


def _late_spans(tags: Column, kind: str) -> Column:
    """Of the places that open or close, each opener before a closer (or the end) is a span."""
    opens = lambda t: t == F.lit(f"B-{kind}")
    places = F.filter(F.transform(tags, lambda t, i: F.when((t == "O") | t.startswith("B-"), i)), lambda i: i.isNotNull())

    def between(at: Column) -> Column:
        each = F.transform(at, lambda i, k: F.struct(i.alias("s"), F.coalesce(F.get(at, k + 1), F.size(tags)).alias("e"), F.lit(kind).alias("label")))
        return F.filter(each, lambda x: opens(F.get(tags, x["s"])) & ~F.coalesce(opens(F.get(tags, x["e"])), F.lit(False)))

    return let(places, between).cast(SPAN)


def padded(pred: Column | str, like: Column | str, fill: str = "O") -> Column:
    """``pred`` cut or filled to the length of ``like``."""
    n = F.size(present(like))
    return F.slice(F.concat(present(pred), F.array_repeat(F.lit(fill), n)), F.lit(1), n)


def span_text(tokens: Column | str, span: Column) -> Column:
    return F.array_join(F.slice(present(tokens), span["s"] + 1, span["e"] - span["s"]), " ")


def span_name(tokens: Column | str, span: Column) -> tuple[Column, Column]:
    """First and last word of a span."""
    return F.get(present(tokens), span["s"]), F.get(present(tokens), span["e"] - 1)


def tag_from_int(tag: Column) -> Column:
    """The tag of an id; ``O`` for an unknown one."""
    ids = F.create_map(*[x for name, i in LABEL_IDS.items() for x in (F.lit(i), F.lit(name))])
    return F.coalesce(F.try_element_at(ids, tag), F.lit("O"))


def label_ids(tags: Column | str) -> Column:
    ids = F.create_map(*[x for name, i in LABEL_IDS.items() for x in (F.lit(name), F.lit(i))])
    return F.transform(present(tags), lambda t: F.try_element_at(ids, t))


def people_only(tags: Column | str, names: Column | str) -> Column:
    """Integer tags of a foreign label list as tags of persons only; all else, and ids out of range, is ``O``."""
    names = col(names)
    return F.transform(
        present(tags, "array<int>"),
        lambda i: F.when(F.get(names, i).isin("B-PER", "I-PER"), F.get(names, i)).otherwise("O"),
    )


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, 0 where b is 0, rounded."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def f1(tp: Column, fp: Column, fn: Column, digits: int = 6) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, digits)


def ascii_safe(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[^\x00-\x7F]", "?")
