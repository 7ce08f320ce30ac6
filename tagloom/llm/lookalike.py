"""Problem 4: text that looks the same but is written in other characters.

A token is repaired in two steps.  Characters that only stand for plain ones are replaced at once:
full-width and compatibility letters, separate accents, invisible characters and non-breaking
blanks and hyphens.  Letters of another script are replaced script by script: the runs of letters
and digits of a token are looked at one by one.  A run of several scripts is read in its dominant script (the one
with most letters, Latin in a tie) and, should that give no word, in Latin; a run of one other script is read in
Latin.  A reading needs a look-alike for every letter of the other scripts and has to be a word of the corpus:
of the tokens or of the texts they were cut from.

A JVM pattern picks the few tokens that can need repair; only these reach Python, in Arrow batches.
The words asked for are looked up in one scan, in which a bitmap of fixed size keeps the others from being moved.

Defined cases: null arrays and null tokens give no row, an empty token is left alone, rows of one id
count once, an empty table gives no rows.  Joiners stay inside scripts that need them and between
emoji; full-width punctuation stays next to Chinese, Japanese or Korean letters.  A word of another script with a
Latin letter in it is repaired in ``p4_tokens`` but imitates no plain text, so it is no row of ``p4_found``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.bitmaps import hash_filter
from tagloom.plans.once import once
from tagloom.plans.staging import stage, table

SPLITS = ("train_injected", "val_injected", "test_injected")
#: Bits of the table of words that are looked for.
WORD_BITS = 1 << 16
#: Words of the corpus that repairs rest on and that are sent to the executors at most; beyond it, repairs are joined.
MOST_WORDS = 200_000

#: Latin letters and the letters of other scripts that print like them.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ",
    "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УҮΥ", "Z": "Ζ",
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "ոη", "o": "оοօ",
    "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕ", "t": "тτ", "u": "սυ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уүγ",
}
TO_LATIN = {other: latin for latin, others in LOOKALIKES.items() for other in others}


def _script(c: str) -> str:
    """The script of a letter by its name."""
    return unicodedata.name(c, "").split(" ", 1)[0]


#: (script, Latin letter) -> the letter of that script that prints like it.
FROM_LATIN = {(_script(other), latin): other for other, latin in TO_LATIN.items()}

#: Letters and digits that print as plain ones.
COMPATIBLE = r"\u0132\u0133\u013f\u0140\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\u212a\u212b\u2160-\u2188\ufb00-\ufb06\x{1D400}-\x{1D7FF}"
BLANKS = r"\u00a0\u2000-\u200a\u202f\u205f\u3000"
HYPHENS = r"\u2011"
INVISIBLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufeff\ufe00-\ufe0f"
FULL_WIDTH = r"\uff01-\uff5e\uffe0-\uffe6"
#: What the JVM looks for before any token is sent to Python.
SUSPECT = rf"[{BLANKS}{HYPHENS}{INVISIBLE}{FULL_WIDTH}{COMPATIBLE}]|\p{{IsLatin}}[\u0300-\u036f]|[\p{{IsGreek}}\p{{IsCyrillic}}\p{{IsArmenian}}\p{{IsCherokee}}]"

_BLANKS, _INVISIBLE = re.compile(f"[{BLANKS}]"), re.compile(f"[{INVISIBLE}]")
_RUN = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*")
#: Scripts whose words may need a joiner; scripts in which full-width marks are usual.
_JOINING = re.compile(r"[\u0600-\u109f\u1780-\u18af\ua8e0-\ua8ff\ufb50-\ufdff\ufe70-\ufefc]")
_RIGHT_TO_LEFT = re.compile(r"[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufefc]")
_EAST_ASIAN = re.compile(r"[\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u31f0-\u31ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff]")
_OTHER = re.compile(r"[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u13a0-\u13ff\u1f00-\u1fff]")
_LATIN = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")


def _pictograph(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk") or c in "\ufe0f\u200d"


def _visible(token: str) -> str:
    out = []
    for i, c in enumerate(token):
        if _INVISIBLE.match(c):
            before, after = token[i - 1 : i] if i else "", token[i + 1 : i + 2]
            joins = c in "\u200c\u200d" and _JOINING.match(before) and (not after or _JOINING.match(after))
            if c == "\u200d":
                emoji = before and after and _pictograph(before) and _pictograph(after)
            else:  # a variation selector picks the picture of a symbol
                emoji = "\ufe00" <= c <= "\ufe0f" and before and (before in "0123456789#*" or not before.isalnum())
            direction = c in "\u200e\u200f\u061c\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069" and _RIGHT_TO_LEFT.search(token)
            if not (joins or emoji or direction):
                continue
        out.append(c)
    return "".join(out)


def _plain(c: str, east_asian: bool) -> str:
    """A full-width or compatibility character as the plain one it prints as."""
    if "\uff01" <= c <= "\uff5e" or "\uffe0" <= c <= "\uffe6":
        return c if east_asian else unicodedata.normalize("NFKC", c)
    if c in "\u212a\u212b":
        return unicodedata.normalize("NFC", c)
    tag = unicodedata.decomposition(c).split(" ", 1)[0]
    if tag in ("<compat>", "<font>") and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl", "Nd"):
        plain = unicodedata.normalize("NFKC", c)
        return plain if plain.isascii() or _LATIN.match(plain) else c
    return c


def _latin(c: str) -> str | None:
    """The Latin letter that a letter of another script prints as, with its accents."""
    base, *marks = unicodedata.normalize("NFD", c)
    return None if base not in TO_LATIN else unicodedata.normalize("NFC", TO_LATIN[base] + "".join(marks))


def _foreign(c: str, script: str) -> str | None:
    """The letter of ``script`` that a Latin letter prints as, with its accents."""
    base, *marks = unicodedata.normalize("NFD", c)
    return None if (script, base) not in FROM_LATIN else unicodedata.normalize("NFC", FROM_LATIN[script, base] + "".join(marks))


def readings(run: str) -> list[str]:
    """The forms of a run of letters and digits in one script, the likeliest first; none for a run that needs no repair."""
    if not _OTHER.search(run):
        return []
    scripts = Counter(_script(c) for c in run if c.isalpha())
    latin = [_latin(c) if _OTHER.match(c) else c for c in run]
    out = []
    top = max(scripts, key=lambda k: (scripts[k], k == "LATIN"))
    if top != "LATIN" and len(scripts) == 2 and "LATIN" in scripts:
        other = [_foreign(c, top) if _LATIN.match(c) else c for c in run]
        out += [] if None in other else ["".join(other)]
    return out + ([] if None in latin else ["".join(latin)])


def _piece(text: str, options: list[str] | None = None) -> tuple[str, list[str]]:
    return text, options or []


def repair(token: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """The form without letters of another script repaired, and its pieces with the readings that the corpus may grant."""
    if token.isascii():
        return token, []
    form = token
    if _BLANKS.search(form):
        form = re.sub(" +", " ", _BLANKS.sub(" ", form)).strip()
    form = _visible(form.replace("\u2011", "-"))
    east_asian = bool(_EAST_ASIAN.search(form))
    form = "".join(c if c.isascii() else _plain(c, east_asian) for c in form)
    form = re.sub(r"[A-Za-z\u00c0-\u024f\u0370-\u052f\u1e00-\u1fff][\u0300-\u036f]+", lambda m: unicodedata.normalize("NFC", m[0]), form)
    pieces, at = [], 0
    for m in _RUN.finditer(form):
        options = readings(m[0])
        if options:
            pieces += [_piece(form[at : m.start()]), _piece(m[0], options)]
            at = m.end()
    return form, [*pieces, _piece(form[at:])] if pieces else []


def read_as_latin(token: str) -> str:
    """The token with every run read in Latin where that is possible, whatever the corpus holds."""
    form, pieces = repair(token)
    return "".join(options[-1] if options else text for text, options in pieces) if pieces else form


PIECES = "array<struct<text:string,options:array<string>>>"


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple] = {}
    for b in batches:
        known = known if len(known) < 100_000 else {}
        for t in set(b["token"]) - known.keys():
            known[t] = repair(t)
        both = [known[t] for t in b["token"]]
        yield b.assign(safe=[x[0] for x in both], pieces=[[{"text": t, "options": o} for t, o in x[1]] for x in both])


def occurrences(rows: DataFrame) -> DataFrame:
    """(idx, pos, token) of the tokens that can need repair; rows: (idx, tokens)."""
    odd = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("token"))), lambda x: x["token"].rlike(SUSPECT))
    # the outer form, for the inner one puts a filter with a copy of the whole expression below the projection
    return rows.where(F.col("idx").isNotNull()).select("idx", F.explode_outer(odd).alias("x")).where("x is not null").select("idx", "x.*")


def known_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(word): those of ``words`` that the corpus has, in lower case; rows: (tokens, sequence).  The words of all rows are read, few are moved."""
    may = hash_filter(words, "word", WORD_BITS)
    text = F.lower(F.concat_ws(" ", F.col("tokens"), F.col("sequence")))
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]++"), F.lit(0))), may)
    return rows.select(F.explode_outer(found).alias("word")).where("word is not null").join(words, "word", "left_semi").distinct()


def marked(rows: DataFrame) -> DataFrame:
    """(idx, pos, token, safe, pieces) of the tokens that can change; rows: (idx, tokens)."""
    out = occurrences(rows).mapInPandas(_repair, f"idx long, pos int, token string, safe string, pieces {PIECES}")
    return stage(out.where("token <> safe or size(pieces) > 0"), "p4-marked")


def granted(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word) of the readings that the corpus has; tokens: ``marked`` ones."""
    options = tokens.select(F.explode_outer(F.flatten(F.transform("pieces", lambda p: p["options"]))).alias("word")).where("word is not null")
    return stage(known_words(rows, stage(options.select(F.lower("word").alias("word")).distinct(), "p4-asked")), "p4-known")


def repaired(rows: DataFrame) -> DataFrame:
    """(idx, pos, token, form) of the tokens that change; rows: (idx, tokens, sequence)."""
    tokens = marked(rows)
    free = tokens.where(F.size("pieces") == 0).select("idx", "pos", "token", F.col("safe").alias("form"))
    ask = tokens.where(F.size("pieces") > 0)
    # one row for each distinct token and reading, joined with the words that are known
    forms = ask.select("safe", "pieces").distinct()
    words = forms.select("safe", F.explode_outer(F.flatten(F.transform("pieces", lambda p: p["options"]))).alias("o")).select("safe", F.lower("o").alias("word"))
    has = words.join(granted(rows, tokens), "word", "left_semi").groupBy("safe").agg(F.collect_set("word").alias("known"))  # at most the readings of one token
    first = lambda p: F.coalesce(F.get(F.filter(p["options"], lambda o: F.array_contains(F.col("known"), F.lower(o))), F.lit(0)), p["text"])
    read = forms.join(has, "safe").select("safe", F.array_join(F.transform("pieces", first), "").alias("form"))
    asked = ask.join(read, "safe", "left").select("idx", "pos", "token", F.coalesce("form", "safe").alias("form"))
    return free.unionByName(asked).where("token <> form").dropDuplicates(["idx", "pos"])


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, t).select("idx", "tokens", "sequence") for t in SPLITS))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, pos) of each token of the three splits that imitates plain text."""
    # where only a Latin letter in a word of another script was replaced, the form has no more Latin letters than the token
    plain = lambda c: F.length(F.regexp_replace(c, r"\P{IsLatin}", ""))
    less = (F.length("token") == F.length("form")) & (plain("form") < plain("token"))
    return repaired(_splits(spark, sf_dir)).where(~less).select("idx", "pos")


def _repair_rows(words):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.value
        forms: dict[str | None, str | None] = {None: None}
        for b in batches:
            forms = forms if len(forms) < 100_000 else {None: None}
            for t in {t for x in b["tokens"] for t in x} - forms.keys():
                safe, pieces = repair(t)
                forms[t] = "".join(next((o for o in options if o.lower() in known), text) for text, options in pieces) if pieces else safe
            yield b.assign(tokens=[[forms[t] for t in x] for x in b["tokens"]])

    return run


def p4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, tokens): the tokens of every record of the three splits in one form.

    Rows stay where they are: only the words that repairs rest on travel, as long as they are at most ``MOST_WORDS``.
    """
    rows = _splits(spark, sf_dir).where(F.col("idx").isNotNull())
    words = granted(rows, marked(rows)).limit(MOST_WORDS + 1).collect()
    single = once(rows.select("idx", "tokens"), "idx")
    if len(words) > MOST_WORDS:
        fixes = repaired(rows).groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "form"))).alias("fixes"))  # at most one entry for each token of a row
        fixed = F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("fixes", i), t))
        return single.join(fixes, "idx", "left").select("idx", F.when(F.col("fixes").isNull(), F.col("tokens")).otherwise(fixed).alias("tokens"))
    known = spark.sparkContext.broadcast(frozenset(r.word for r in words))
    odd = F.coalesce(F.exists("tokens", lambda t: F.coalesce(t.rlike(SUSPECT), F.lit(False))), F.lit(False))
    return single.where(~odd).unionByName(single.where(odd).mapInPandas(_repair_rows(known), "idx long, tokens array<string>"))
