"""Prompts for a language model, and its answers as names, addresses and tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio

#: The prompt.
SYSTEM = (
    "You are a precise PII detection system. Your task is to identify person names and email addresses\n"
    "in text. Return ONLY a valid JSON object. No explanations. No preamble. No markdown. No commentary.\n"
    "Rules:\n"
    '- Extract full names as they appear (e.g., "John Smith", not "John" and "Smith" separately)\n'
    "- Do NOT extract honorifics like Dr., Mr., Mrs., Prof. as part of the name unless inseparable\n"
    "- Do NOT extract organizations, locations, or other entities - only person names and emails\n"
    "- If no names or emails are found, return empty lists"
)
PROMPT_HEAD = (
    "<|start_header_id|>system<|end_header_id|>\n" + SYSTEM + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
    "Identify all person names and email addresses in the following sentence.\nReturn ONLY this JSON structure with no other text:\n"
    '{"names": ["..."], "emails": ["..."]}\n\nSentence: '
)
PROMPT_TAIL = "\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
_SPACES = " \t\n\r\f\x0b"


def prompt(sentence: Column | str) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), bio.col(sentence), F.lit(PROMPT_TAIL))


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def cleaned(response: Column | str) -> Column:
    """The answer without blanks around it, a leading ``assistant`` and a code fence."""
    text = _trim(bio.col(response))
    text = F.when(text.startswith("assistant"), _trim(F.substring(text, 10, 1_000_000_000))).otherwise(text)

    def unfenced(t: Column) -> Column:
        json_fence, plain = r"(?s)```json\s*(.*?)```", r"(?s)```\s*(.*?)```"
        return F.when(t.rlike(json_fence), _trim(F.regexp_extract(t, json_fence, 1))).when(t.rlike(plain), _trim(F.regexp_extract(t, plain, 1))).otherwise(t)

    return bio.let(text, unfenced)


def _listed(v: Column, key: str) -> Column:
    """The strings of a list in a JSON object; null where it is there but no list."""
    items = F.try_variant_get(v, f"$.{key}", "array<variant>")
    there = F.try_variant_get(v, f"$.{key}", "variant")
    strings = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.transform(strings, lambda x: F.try_variant_get(x, "$", "string"))
    missing = there.isNull() & ~F.to_json(v).contains(f'"{key}":')
    return F.when(missing, F.array().cast("array<string>")).otherwise(texts)


def parsed(rows: DataFrame, response: str = "raw_response") -> DataFrame:
    """Adds stage, parse_ok, names and emails: direct JSON, then the widest braces, then quoted items of both fields.

    JSON that is no object, and a field that is no list, count as not parsed.
    """
    rows = rows.withColumn("_t", F.coalesce(cleaned(response), F.lit("")))
    widest = F.regexp_extract("_t", r"(?s)(\{.*\})", 1)
    rows = rows.withColumns({"_v1": F.try_parse_json("_t"), "_v2": F.try_parse_json(F.when(widest != "", widest))})
    stage = F.when(F.col("_v1").isNotNull(), 1).when(F.col("_v2").isNotNull(), 2).when(F.col("_t").contains("{"), 3).otherwise(0)
    rows = rows.withColumn("stage", stage).withColumn("_v", F.when(F.col("stage") == 1, F.col("_v1")).when(F.col("stage") == 2, F.col("_v2")))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    fragment = F.regexp_extract("_t", r"(?s)(\{.*)", 1)
    quoted = lambda key: F.regexp_extract_all(F.regexp_extract(fragment, rf'"{key}"\s*:\s*\[([^\]]*)', 1), F.lit('"([^"]+)"'), F.lit(1))
    for key in ("names", "emails"):
        found = F.when(F.col("stage") == 3, quoted(key)).when(is_object, _listed(F.col("_v"), key))
        rows = rows.withColumn(f"_{key}", found)
    ok = F.col("_names").isNotNull() & F.col("_emails").isNotNull() & (F.col("stage") > 0)
    kept = lambda key: F.when(F.col("parse_ok"), F.filter(f"_{key}", lambda x: _trim(x) != "")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("parse_ok", F.coalesce(ok, F.lit(False))).withColumns({"names": kept("names"), "emails": kept("emails")}).drop("_t", "_v1", "_v2", "_v", "_names", "_emails")


def grounded(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Keeps the items that are in the text, whatever their case."""
    low = F.lower(F.coalesce(F.col(sequence), F.lit("")))
    inside = lambda c: F.filter(c, lambda x: F.contains(low, F.lower(_trim(x))))
    return rows.withColumns({"names": inside("names"), "emails": inside("emails")})


def without_mail_names(rows: DataFrame) -> DataFrame:
    """Drops names that are part of an address."""
    low = F.transform("emails", lambda e: F.lower(_trim(e)))
    return rows.withColumn("names", F.filter("names", lambda n: ~F.exists(low, lambda e: F.contains(e, F.lower(_trim(n))))))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\p{Punct}+|\p{Punct}+$", "")


def aligned(tokens: Column | str, names: Column | str, emails: Column | str) -> Column:
    """Tags: addresses first, then names, each on the first free window of equal words."""
    tokens = bio.present(tokens)
    entity = lambda c, kind: F.transform(bio.col(c), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind")))
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def window(bare: Column, tags: Column, parts: Column) -> Column:
        n = F.size(parts)
        free = lambda p: (F.slice(bare, p + 1, n) == parts) & F.forall(F.slice(tags, p + 1, n), lambda t: t == "O")
        places = F.when((n > 0) & (F.size(bare) >= n), F.filter(F.sequence(F.lit(0), F.greatest(F.size(bare) - n, F.lit(0))), free))
        return F.get(places, F.lit(0))

    def place(bare: Column) -> Column:
        def step(tags: Column, e: Column) -> Column:
            low = F.lower(_trim(e["text"]))
            mail = F.contains(low, F.lit("@"))
            split = F.transform(words(F.replace(low, F.lit("@"), F.lit(" @ "))), _stripped)
            plain = F.transform(words(low), _stripped)
            whole = F.when(mail, F.get(F.filter(F.sequence(F.lit(0), F.size(bare)), lambda i: (F.get(bare, i) == _stripped(low)) & (F.get(tags, i) == "O")), F.lit(0)))
            parts = F.when(mail & (F.size(split) >= 2), window(bare, tags, split))
            at = F.when(whole.isNotNull(), F.struct(whole.alias("p"), F.lit(1).alias("n"))).when(
                parts.isNotNull(), F.struct(parts.alias("p"), F.size(split).alias("n"))).otherwise(F.struct(window(bare, tags, plain).alias("p"), F.size(plain).alias("n")))
            put = lambda a: F.transform(tags, lambda t, i: F.when(i == a["p"], F.concat(F.lit("B-"), e["kind"])).when((i > a["p"]) & (i < a["p"] + a["n"]), F.concat(F.lit("I-"), e["kind"])).otherwise(t))
            return bio.let(at, put)

        start = F.transform(tokens, lambda _: F.lit("O"))
        return F.aggregate(F.concat(entity(emails, "EMAIL"), entity(names, "PER")), start, step)

    return bio.let(F.transform(tokens, lambda t: _stripped(F.lower(t))), place)


Backend = Callable[[list[str]], list[str]]


def answered(rows: DataFrame, backend: Backend, prompts: str = "prompt") -> DataFrame:
    """Adds ``raw_response`` by a backend that maps prompts to answers, in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", raw_response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(raw_response=backend(b[prompts].tolist()))

    return rows.mapInPandas(run, schema)


def rule_backend(prompts: list[str]) -> list[str]:
    """The built-in detector: capitalised pairs and addresses by pattern, answered as JSON."""
    import json
    import re

    out = []
    for p in prompts:
        text = p.rsplit("Sentence: ", 1)[-1].split("\n<|eot_id|>", 1)[0]
        mails = re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", text)
        names = re.findall(r"\b[A-Z][\w'-]+ [A-Z][\w'-]+\b", text)
        out.append(json.dumps({"names": names, "emails": mails}, ensure_ascii=False))
    return out


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows whose id has no answer yet; running again resumes."""
    return rows.join(done.select("idx").distinct(), "idx", "left_anti")
