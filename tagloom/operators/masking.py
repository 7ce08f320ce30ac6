"""Masking of predicted spans in the text of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio

#: The placeholders.
PLACEHOLDERS = {"PER": "[NAME]", "EMAIL": "[EMAIL]"}


def placeholder(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, label), F.concat(F.lit("["), label, F.lit("]")))


def _found(sequence: Column, token: Column, pos: Column) -> Column:
    at = F.when(token == "", pos).otherwise(F.call_function("locate", token, sequence, pos + 1) - 1)
    return F.struct(at.alias("from"), F.when(at < 0, F.lit(-1)).otherwise(at + F.length(token)).alias("to"))


_RANGE = "struct<from:int,to:int,label:string>"


def _walk(sequence: Column, tokens: Column, spans: Column) -> Column:
    """One pass over the tokens, each searched from the end of the last one found: ``r``, the ranges of the spans, and
    ``missed``.  The state grows with the spans only.  A span starts where its first token is and ends with the last
    of its tokens that is found; it is missed without its first token and dropped where it starts inside the one before."""

    def step(state: Column, token: Column) -> Column:
        def with_place(f: Column) -> Column:
            f = f["f"]
            span = F.get(spans, state["k"])
            inside = F.coalesce(state["i"] >= span["s"], F.lit(False))
            first = F.coalesce(state["i"] == span["s"], F.lit(False))
            a = F.when(first, f["from"]).otherwise(state["a"])
            b = F.greatest(F.when(first, F.lit(-1)).otherwise(state["b"]), F.when(inside, f["to"]).otherwise(F.lit(-1)))
            closes = inside & (state["i"] == span["e"] - 1)
            located = closes & (a >= 0) & (b >= 0)
            keeps = located & (a >= state["end"])
            return F.struct(
                (state["i"] + 1).alias("i"), F.greatest(state["pos"], f["to"]).alias("pos"), F.when(closes, state["k"] + 1).otherwise(state["k"]).alias("k"), a.alias("a"), b.alias("b"),
                F.when(keeps, b).otherwise(state["end"]).alias("end"), (state["missed"] + (closes & ~located).cast("int")).alias("missed"),
                F.when(keeps, F.concat(state["r"], F.array(F.struct(a.alias("from"), b.alias("to"), span["label"].alias("label"))))).otherwise(state["r"]).alias("r"),
            )

        return bio.let(F.struct(_found(sequence, token, state["pos"]).alias("f")), with_place)

    zero = lambda n: F.lit(0).alias(n)
    none = F.lit(-1)
    start = F.struct(zero("i"), zero("pos"), zero("k"), none.alias("a"), none.alias("b"), none.alias("end"), zero("missed"), F.array().cast(f"array<{_RANGE}>").alias("r"))
    return F.aggregate(tokens, start, step, lambda s: F.struct(s["r"].alias("r"), s["missed"].alias("missed")))


def with_ranges(rows: DataFrame, spans: str = "pred_spans") -> DataFrame:
    """Adds ``ranges`` (from, to, label) of the locatable spans in order, without overlaps, and ``n_unlocated``."""
    rows = rows.withColumn("_walk", bio.let(F.struct(F.col(spans).alias("x")), lambda s: _walk(F.col("sequence"), F.col("tokens"), s["x"])))
    return rows.withColumns({"ranges": F.col("_walk.r"), "n_unlocated": F.col("_walk.missed")}).drop("_walk")


def masked(rows: DataFrame, spans: str = "pred_spans", tags: str = "pred", strict: bool = True) -> DataFrame:
    """Adds ``masked``: the text with one placeholder for each located span; a null text stays null.

    Tags and tokens of unequal number are an error; without ``strict`` such a text stays as it is.
    """
    fits = F.size(bio.present(tags)) == F.size(bio.present("tokens"))
    if strict:
        message = F.concat(F.lit("tags length "), F.size(bio.present(tags)).cast("string"), F.lit(" != tokens length "), F.size(bio.present("tokens")).cast("string"))
        rows = rows.withColumn(spans, F.when(fits, F.col(spans)).otherwise(F.raise_error(message).cast(bio.SPAN)))
    else:
        rows = rows.withColumn(spans, F.when(fits, F.col(spans)).otherwise(F.array().cast(bio.SPAN)))
    rows = with_ranges(rows, spans)
    text = F.aggregate(
        "ranges", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col("sequence"), s["at"] + 1, x["from"] - s["at"]), placeholder(x["label"])).alias("out"), x["to"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col("sequence"), s["at"] + 1, F.length("sequence"))),
    )
    return rows.withColumn("masked", F.when(F.col("sequence").isNull(), F.lit(None)).otherwise(text))


def with_sequence(rows: DataFrame, empty_too: bool = False) -> DataFrame:
    """Rebuilds a missing text from the tokens and counts it in ``rebuilt``; ``empty_too`` treats an empty one alike."""
    gone = F.col("sequence").isNull() | (F.lit(empty_too) & (F.col("sequence") == ""))
    return rows.withColumn("rebuilt", gone).withColumn("sequence", F.when(gone, F.array_join("tokens", " ")).otherwise(F.col("sequence")))


#: What the ends of an entity's text are stripped of: blanks of all kinds.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def leaks(rows: DataFrame) -> DataFrame:
    """Adds ``leaks``: whether the text of a gold span is still in the masked text, whatever its case; blank spans leak nothing."""
    text = lambda x: F.lower(F.btrim(bio.span_text("tokens", x), F.lit(BLANKS)))
    in_it = lambda low: F.exists(F.transform("gold_spans", text), lambda t: (t != "") & F.contains(low, t))
    return rows.withColumn("leaks", bio.let(F.lower("masked"), in_it))
