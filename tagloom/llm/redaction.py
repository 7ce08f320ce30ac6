"""Problem 3: personal information in free text.

High-recall generators propose overlapping spans: patterns for e-mail addresses (spelled-out and
spaced forms too), phone numbers, identity numbers and street addresses, and stretches of name-like words.  Boosted trees, one model a kind, score each span by its format and its
surroundings; a threshold calibrated on held-out rows selects, and of overlapping spans the best one
stays.

The models are fitted for each run on a bounded sample of the labelled training split
(``SAMPLE_ROWS`` rows, by a hash of the id): person tags label the names; e-mail addresses, numbers,
addresses and look-alikes of them (book numbers, catalogue numbers, handles, roads without a house
number) are written into those rows, so their spans are known; the trees of a kind see at most ``FIT_SPANS`` of the
candidates of those rows.  The answer for a test row rests on
its two fields only.  Texts without upper and lower case to go by are handled by the same features:
every word that is not a common one is name-like there.

Defined cases: null texts and null or empty token lists give no spans; null tokens count as empty;
rows of one id count once; an empty training split leaves every text as it is, as does an empty test.
"""

from __future__ import annotations

import pickle
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.boosting import BoostedTrees
from tagloom.llm.lookalike import FULL_WIDTH, read_as_latin
from tagloom.plans.staging import table

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
#: Bounds of the labelled sample: rows, and candidate spans of one kind.
SAMPLE_ROWS, FIT_SPANS = 12000, 60_000
#: Inside a stretch of name-like words all parts of up to so many words are proposed, and all that reach from one of its
#: ends to any place, so every name that fills a stretch, or begins or ends one, is proposed whole whatever its length.
NEAR_WORDS = 8
#: Words that the labelled rows hold this often outside of names and never inside one are no part of a stretch.
NEVER_LEAST = 40

PIECE = re.compile(r"[^\W\d_]+(?:[̀-ͯ­​-‏⁠﻿]+[^\W\d_]*|['’ʼ](?!s\b|S\b)[^\W\d_]+|-[^\W\d_]{2,})*|\d+|\S")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_ODD = re.compile(f"[{FULL_WIDTH}\u00ad\u0300-\u03ff\u0400-\u052f\u200b-\u200f\u2060\ufeff]")
TITLES = set("mr mrs ms miss dr prof professor sir dame lord lady rev fr sr st saint captain capt col gen lt sgt hon herr frau mme mlle m señor señora don doña".split()) - {"m", "fr", "sr"}
PARTICLES = set("de del della di da dos das du van von der den zu zur al el la le ben bin ibn af av ter ten y e".split())
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd"}

# ---------------------------------------------------------------- generators

_AT = r"(?: ?@ ?| ?[\(\[\{] ?at ?[\)\]\}] ?| at )"
_DOT = r"(?:\.| \. | ?[\(\[\{] ?dot ?[\)\]\}] ?| dot )"
EMAIL = re.compile(rf"(?P<local>[^\W]+(?:(?:[.+_-]| [.+_-] |{_DOT})[^\W]+)*){_AT}(?P<domain>[^\W_]+(?:(?:-| - )[^\W_]+)*(?:{_DOT}[^\W_]+(?:-[^\W_]+)*)+)", re.I)
_TLD = re.compile(r"(?:example|test|invalid|com|org|net|edu|gov|info|io|[a-z]{2})\Z", re.I)
NUMBER = re.compile(r"(?:\+ ?)?\(? ?\d[\d]*(?: ?\))?(?:(?: ?[-./‐-―] ?| )\(? ?\d+(?: ?\))?)*")
CODE = re.compile(
    r"\b(?:[A-Z]{1,3} ?\d{2,}(?:(?: ?[-./] ?| )\d+)*(?:(?: ?- ?| )[A-Z]\b)?|[A-Z]{1,2}(?: \d{2}){3} [A-Z]\b|\d{6,}(?: ?- ?)[A-Z]\b|\d+(?:(?: ?[-./] ?| )\d+)+(?:(?: ?- ?| )[A-Z]\b)?|\d{6,}[A-Z]?)", re.I
)
_STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Drive|Dr\b\.?|Close|Terrace|Way|Court|Ct\b\.?|Place|Square|Crescent|Boulevard|Blvd\b\.?|Row)(?!\w)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\b\.? ?\d+[a-z]?)"
_WORD_OF_TOWN = r"[^\W\d_][\w​-‏⁠﻿­'’-]+"
_TOWN = rf"{_WORD_OF_TOWN}(?: (?:Hill|Bay|Green|Park|Heath|Cross))?"
#: A town of any number of words; each of them may be the last.
_TOWNS = rf"{_WORD_OF_TOWN}(?: (?:(?:Hill|Bay|Green|Park|Heath|Cross)\b|(?-i:(?![a-zß-öø-ÿа-я])[^\W\d_][^\W\d_'’-]*(?!\w))))*"
_SEP = r"(?: ?, ?| )"
_HEAD = (
    rf"(?:(?:{_UNIT}{_SEP})?\d+ ?[a-z]?\b{_SEP}(?:[NSEW]\b ?\. ?|(?:North|South|East|West) )?(?:{_TOWN} ){{1,2}}{_STREET}(?: ?, ?{_UNIT})?"
    rf"|(?:{_UNIT}{_SEP})?[^\W\d_][\w​-‏⁠﻿­-]*(?:weg|straße|strasse|gasse|platz|allee)\b {{0,2}}\d+ ?[a-z]?\b"
    rf"|\d+ ?,? ?(?:bis |ter )?(?:rue|avenue|boulevard|place|chemin) (?:de la |de |du |des |d['’])?{_TOWN}"
    rf"|(?:Calle|Avenida|Plaza|Via|Rua)\b (?:de la |de |del )?{_TOWN} ?,? ?\d+[a-z]?\b)"
)
HEAD = re.compile(_HEAD, re.I)
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}\b|\d{5}\b)"
_TAIL = rf"(?: ?, ?(?P<code>{_POST})(?P<t1> TOWN)?| ?, ?(?P<town>TOWN)(?P<code2>,? {_POST})?)"
TAIL, LONG_TAIL = (re.compile(_TAIL.replace("TOWN", x), re.I) for x in (_TOWN, _TOWNS))


#: What a text must have for the costlier patterns to be tried.
_MAY_MAIL = re.compile(r"@|[\(\[\{] ?at\b|\bdot\b|\bat [^\W_]+(?:(?:-| - )[^\W_]+)* ?(?:\.|[\(\[\{] ?dot)", re.I)
_MAY_NUMBER = re.compile(r"\d[\d ().+/‐-―-]{4,}\d|[A-Za-z] ?\d{2}", re.I)
_MAY_ADDRESS = re.compile(rf"\b{_STREET}|(?:weg|straße|strasse|gasse|platz|allee)\b|\b(?:rue|avenue|boulevard|place|chemin|calle|avenida|plaza|via|rua)\b", re.I)


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    if not _MAY_MAIL.search(text):
        return
    at = 0
    while m := EMAIL.search(text, at):
        # starts: every piece of the local part; ends: every label that can close a domain
        starts = [m.start("local") + x.start() for x in re.finditer(r"\w[^\s]*", m["local"])]
        ends = [m.start("domain") + x.end() for x in re.finditer(r"[^\W_]+", m["domain"]) if x.start() and _TLD.match(x[0])]
        for s in starts:
            for e in ends:
                yield s, e
        at = m.start("domain")  # the domain may hold the local part of a next one


def _number_spans(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    if not _MAY_NUMBER.search(text):
        return
    for m in pattern.finditer(text):
        s, e = m.span()
        if sum(c.isdigit() for c in m[0]) >= 5 or re.search(r"[A-Za-z]", m[0]):
            yield s, e
            # without brackets of the sentence, and without a first or a last group
            inner = s + len(re.match(r"[( ]*", m[0])[0]), s + len(m[0].rstrip(") "))
            yield inner
            yield s, inner[1]
            yield inner[0], e
            for x in re.finditer(r"\d+(?: ?\))?", m[0]):
                if sum(c.isdigit() for c in m[0][x.start() :]) >= 6:
                    yield s + x.start(), inner[1]
                    if x.start() and m[0][x.start() - 1] in "(+":
                        yield s + x.start() - 1, inner[1]
                if sum(c.isdigit() for c in m[0][: x.end()]) >= 6:
                    yield s, s + x.end()
                    yield inner[0], s + x.end()


def _word_ends(text: str, s: int, e: int) -> Iterator[int]:
    """The ends of the words of a stretch."""
    for x in re.finditer(r"(?=[ ,]|\Z)", text[s:e]):
        if x.start():
            yield s + x.start()


def _address_spans(text: str) -> Iterator[tuple[int, int]]:
    if not _MAY_ADDRESS.search(text):
        return
    for m in HEAD.finditer(text):
        yield m.span()
        # one tail after the other, postcodes and towns; of a town with more capitalised words behind it each word may be the last
        open_, seen = [m.end()], {m.end()}
        while open_:
            at = open_.pop()
            t = TAIL.match(text, at)
            if not t:
                continue
            ends = [t.end(), *(t.end(g) for g in ("code", "town") if t[g] is not None)]
            more = LONG_TAIL.match(text, at)
            for g in ("t1", "town"):
                if more[g] is not None and t[g] is not None and more.end(g) > t.end(g):
                    ends += [more.end(), *(e for e in _word_ends(text, *more.span(g)) if e > t.end(g))]
            for e in ends:
                if e not in seen:
                    seen.add(e)
                    yield m.start(), e
                    if t["town"] is not None:
                        open_.append(e)


class Pieces:
    """A text cut into words, numbers and marks."""

    __slots__ = ("text", "spans", "words", "low", "caseless", "starts", "ends", "like", "firsts", "around")

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in PIECE.finditer(text)]
        self.words = [text[s:e] for s, e in self.spans]
        if _ODD.search(text):  # look-alikes are read as the letters they stand for; places stay those of the text
            self.words = [_HIDDEN.sub("", read_as_latin(w)) or "." for w in self.words]
        self.low = [w.lower() for w in self.words]
        letters = sum(w[0].isalpha() for w in self.words)
        upper = sum(w[0].isupper() for w in self.words)
        lower = sum(w[0].islower() for w in self.words)
        self.caseless = letters > 3 and (upper <= 0.03 * letters or lower <= 0.03 * letters)
        self.firsts = [s for s, _ in self.spans]
        self.starts = {s: i for i, s in enumerate(self.firsts)}
        self.ends = {e: i for i, (_, e) in enumerate(self.spans)}
        self.like: list[bool] = []
        self.around = ["<", "<", *("0" if w[0].isdigit() else w for w in self.low), ">", ">"]

    def mark(self, common: set[str], never: set[str]) -> None:
        """Finds the name-like words: capitalised and not known to be none, in a caseless text any uncommon one."""
        if self.caseless:
            self.like = [w[0].isalpha() and w not in TITLES and w not in never and w not in common for w in self.low]
        else:
            self.like = [w[0].isupper() and x not in never and x not in TITLES for w, x in zip(self.words, self.low)]


def _stretch(p: Pieces, i: int) -> Iterator[tuple[int, int]]:
    """(first, last) pieces of the spans of the stretch that starts at ``i``, the shortest first; every span is one more word."""
    n, j, count = len(p.words), i, 0
    while j < n:
        if p.like[j]:
            yield i, j
            count += 1
            if count == 1 and j + 2 < n and p.words[j + 1] == "," and p.like[j + 2]:  # family name, given name
                yield i, j + 2
                if j + 4 < n and len(p.words[j + 3]) == 1 and p.words[j + 4] == ".":
                    yield i, j + 3
            k = j + 1
            if k < n and p.words[k] == "." and (len(p.words[j]) == 1 or p.low[j] in SUFFIXES):
                if p.low[j] in ("jr", "sr"):
                    yield i, k
                k += 1
            if k < n and p.words[k] == "," and k + 1 < n and p.low[k + 1] in SUFFIXES:
                k += 1
            while k < n and p.low[k] in PARTICLES and not p.like[k]:
                k += 1
            if k >= n or not (p.like[k] or p.low[k] in SUFFIXES):
                return
            j = k
        elif p.low[j] in SUFFIXES:
            yield i, j
            return
        else:
            return


def _name_spans(p: Pieces) -> Iterator[tuple[int, int]]:
    """(first, last) pieces of every stretch that may be a name; ``p`` is marked."""
    n, i = len(p.words), 0
    while i < n:
        if not p.like[i]:
            i += 1
            continue
        whole = list(_stretch(p, i))
        end = max(j for _, j in whole)
        yield from whole
        for k in range(i + 1, end + 1):
            if p.like[k]:
                yield from islice(_stretch(p, k), NEAR_WORDS)
                if end - k >= NEAR_WORDS:  # from here to the end of the stretch
                    yield k, end
        i = end + 1


# ---------------------------------------------------------------- features

CUES = {
    "EMAIL": "mail email e write reply contact to address".split(),
    "PHONE": "tel telephone phone mobile fax call ring number reachable contact cell tél telefon móvil".split(),
    "ID": "passport licence license driver ssn security insurance national tax steuer id dni nie identity identification nino social".split(),
    "ADDRESS": "living resident address post lives home resides of at".split(),
}
AGAINST = "isbn catalogue catalog accession shelf items season seasons chapter page item order lot ticket handle paved won by isbn- issn doi no".split()


def _around(p: Pieces, s: int, e: int) -> tuple[int, int]:
    """Indices of the pieces that hold the first and the last character."""
    return max(bisect_right(p.firsts, s) - 1, 0), max(bisect_right(p.firsts, e - 1) - 1, 0)


def span_features(p: Pieces, s: int, e: int) -> list[float]:
    """Format and surroundings of a span of contact data."""
    t = p.text[s:e]
    i, j = _around(p, s, e)
    before = p.low[max(0, i - 5) : i]
    groups = re.findall(r"\d+", t)
    digits = sum(map(len, groups))
    near = [w for w in before if w[0].isalpha()][-3:]
    row: list[float] = [
        len(t), digits, len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0),
        t[0] == "+", t[0] == "(", t.count("(") - t.count(")"), "-" in t, "." in t, "/" in t, "@" in t,
        sum(c.isalpha() for c in t), t[0].isalpha(), t[-1].isalpha(), t[:1] == "0", bool(groups) and groups[0][0] == "0",
        s > 0 and p.text[s - 1].isalnum(), e < len(p.text) and p.text[e].isalnum(),
        e < len(p.text) - 1 and p.text[e : e + 3].strip()[:1].isdigit(), s > 1 and p.text[max(0, s - 2) : s].strip()[-1:].isdigit(),
        s > 0 and p.text[max(0, s - 2) : s].strip()[-1:] in "-.+_@/(", e < len(p.text) and p.text[e : e + 2].strip()[:1] in "-_@/+",
        t.count(","), t.count(" "), sum(w.islower() for w in t.split()), bool(HEAD.match(t)), digits and t.count(" ") / digits,
        bool(re.match(r" ?\. ?[^\W\d_]{2}", p.text[e : e + 6])), bool(re.match(r" ?,? ?\d", p.text[e : e + 5])),
        p.text[e : e + 4].strip()[:1] in (",", ")", ".", "!", ""), p.text[e : e + 4].strip()[:1].islower(),
    ]
    tail = TAIL.match(p.text, e)
    row += [bool(tail), bool(tail and (tail["code"] or tail["code2"])), bool(tail and tail["town"] and tail["town"][0].isupper()), bool(tail and p.text[tail.end() :][:2].strip()[:1] in (")", ",", ".", ""))]
    for kind in ("EMAIL", "PHONE", "ID", "ADDRESS"):
        row.append(min([len(near) - k for k, w in enumerate(near) if w in CUES[kind]], default=9))
    row.append(min([len(near) - k for k, w in enumerate(near) if w in AGAINST], default=9))
    row.append(bool(before) and before[-1] in AGAINST)
    return row


class Statistics:
    """Log-odds of words and contexts, from one part of the sample."""

    def __init__(self):
        self.common: set[str] = set()
        self.never: set[str] = set()
        self.odds: dict[str, dict] = {}
        self.given: set[str] = set()
        self.family: set[str] = set()

    def fit(self, rows: list[tuple[Pieces, list[tuple[int, int, str]]]], given: set[str], family: set[str]) -> Statistics:
        self.given, self.family = given, family
        lows: Counter = Counter()
        for p, _ in rows:
            if not p.caseless:
                lows.update(w for w in p.words if w.islower())
        self.common = {w for w, n in lows.items() if n >= 2}
        counts: dict[str, dict] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        gold: list[set] = []
        for p, spans in rows:
            inside = np.zeros(len(p.words), bool)
            gold.append(set())
            for s, e, kind in spans:
                if kind == "NAME" and s in p.starts and e in p.ends:
                    inside[p.starts[s] : p.ends[e] + 1] = True
                    gold[-1].add((p.starts[s], p.ends[e]))
            for i, w in enumerate(p.low):
                if w[0].isalpha():
                    hit = int(inside[i])
                    for name, key in (("word", w), ("end3", w[-3:]), ("end5", w[-5:])):
                        counts[name][key][hit] += 1
        self.never = {w for w, (no, yes) in counts["word"].items() if no >= NEVER_LEAST and not yes}
        for (p, _), g in zip(rows, gold):
            p.mark(self.common, self.never)
            for i, j in _name_spans(p):
                hit = int((i, j) in g)
                for name, key in self._contexts(p, i, j):
                    counts[name][key][hit] += 1
        for name, table_ in counts.items():
            no, yes = (sum(v[k] for v in table_.values()) for k in (0, 1))
            prior = np.log((yes + 1) / (no + 1))
            self.odds[name] = {k: float(np.log((v[1] + 0.5) / (v[0] + 0.5)) - prior) for k, v in table_.items() if v[0] + v[1] >= 2}
        return self

    @staticmethod
    def _contexts(p: Pieces, i: int, j: int) -> list[tuple[str, object]]:
        w = p.around
        return [("prev", w[i + 1]), ("prev2", (w[i], w[i + 1])), ("next", w[j + 3]), ("next2", (w[j + 3], w[j + 4]))]

    def features(self, p: Pieces, i: int, j: int) -> list[float]:
        word, end3, end5 = (self.odds.get(k, {}) for k in ("word", "end3", "end5"))
        words = [w for w in p.low[i : j + 1] if w[0].isalpha()]
        real = [w for w in words if len(w) > 1 and w not in PARTICLES and w not in SUFFIXES] or words
        at = [word.get(w, 0.0) for w in real]
        first, last = real[0], real[-1]
        n = len(p.words)
        like = lambda k: float(0 <= k < n and p.like[k])
        after = j + 1 if j + 1 < n and p.words[j + 1] != "." else j + 2
        return [
            len(words), sum(len(w) == 1 for w in words), sum(w in PARTICLES for w in words), sum(w in SUFFIXES for w in words), "-" in last, "," in p.words[i : j + 1],
            *(self.odds.get(name, {}).get(key, 0.0) for name, key in self._contexts(p, i, j)),
            first in self.given, last in self.family or any(x in self.family for x in last.split("-")), first in self.family, last in self.given,
            at[0], at[-1], min(at), sum(at) / len(at), end3.get(last[-3:], 0.0), end5.get(last[-5:], 0.0), end5.get(first[-5:], 0.0),
            like(i - 1) or float(i > 1 and p.words[i - 1] == "." and len(p.words[i - 2]) == 1), like(j + 1), like(after),
            float(j + 1 < n and p.low[j + 1] in PARTICLES and like(j + 2)), float(i > 0 and p.low[i - 1] in PARTICLES),
            float(i > 0 and p.low[i - 1] in TITLES or i > 1 and p.low[i - 2] in TITLES), p.caseless, i == 0, len(last), float(last in self.common), float(first in self.common),
        ]


# ---------------------------------------------------------------- labelled sample

_LETTERS = "ABCDEFGHJKLMNPRSTVWXYZ"


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _filled(r: random.Random, form: str) -> str:
    """'#' is a digit, 'A' in angle brackets a letter."""
    return re.sub("<A>", lambda _: r.choice(_LETTERS), re.sub("#", lambda _: r.choice("0123456789"), form))


_PHONES = ("+## #### ######", "+# ### ### ####", "+## ## ##### ###", "##### ######", "### #### ####", "(###) ###-####", "(##) #### ####", "## ## ## ## ##", "###.###.####", "###-###-####", "0### ### ####")
_IDS = (("passport", "<A>#######"), ("passport no.", "<A>#######"), ("driver licence", "<A>###-####-####"), ("licence no.", "<A>###-####-####"), ("SSN", "###-##-####"),
        ("social security no.", "###-##-####"), ("National Insurance no.", "<A><A> ## ## ## <A>"), ("Steuer-ID", "## ### ### ###"), ("tax ID", "## ### ### ###"), ("DNI", "########-<A>"), ("identity card", "<A><A>######"))
_NEITHER = ("ISBN 97#-#-####-####-#", "ISBN 97# - # - #### - #### - #", "catalogue no. ####-###", "accession 19##.###.##", "shelf ### ### ###", "seasons 19##-##", "items #,### - ###", "handle @{w}_{w}", "paved as {t} Road",
            "along {t} Street", "##.#### N , #.#### W", "lot ### ###", "order ####-####", "vol. ## , pp. ###-###", "won ## - ###", "( 17## - 18## )", "ticket ### ### ###", "ISSN ####-####", "no. ###-####-##")
_NAME_CUES = ("attn.", "c/o", "filed by", "signed by", "ask for", "contact", "care of", "via")
_PHONE_CUES = ("tel.", "call", "phone:", "mobile", "fax", "reachable on", "contact number", "", "")
_MAIL_CUES = ("write to", "reply to", "mail:", "e-mail", "Email:", "contact", "", "")
_HOME_CUES = ("living at", "resident at", "address:", "post to", "of", "lives at", "", "")


def _street(r: random.Random, town) -> str:
    kind = r.choice(["Street", "Road", "Lane", "Avenue", "Drive", "Close", "Terrace", "St.", "Rd", "Way"])
    number = str(r.randint(1, 240))
    end = r.choice(["", f" , {town()}", f" , {town()}", f" , {town()} Hill", f" , {town()} Bay {_filled(r, '<A><A># #<A><A>')}", f" , {town()} {_filled(r, '<A><A># #<A><A>')}"])
    return r.choice([
        f"{number} {town()} {kind}{end}", f"{number}{r.choice('abc')} {town()} {kind}{end}", f"Flat {r.randint(1, 40)} , {number} {town()} {kind}{r.choice(['', end])}",
        f"{number} {r.choice('NSEW')}. {town()} {kind} , Apt {r.randint(1, 30)} , {town()}{r.choice(['', ' Hill', ' Bay'])}",
        f"{town()}weg {number} , {_digits(r, 5)} {town()}{r.choice(['', ' Hill', ' Bay'])}", f"{number} rue de {town()}", f"Calle {town()} {number}{r.choice(['', f' , {town()}'])}",
    ])


def _mail(r: random.Random, word) -> str:
    local = r.choice([f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{r.randint(1, 99)}", f"{word()[:1]}{word()}", "info", "hello", f"{word()}.{word()[:1]}", f"{word()}+list"])
    domain = r.choice([f"{word()}.example", f"{word()}.test", "example.com", "example.org", f"mail.{word()}.net", f"{word()}.com"])
    form = r.random()
    if form < 0.2:
        local, domain = local.replace(".", r.choice([".", " . "])).replace("_", r.choice(["_", " _ "])).replace("+", " + "), domain
        return f"{local} @ {domain.replace('.', r.choice(['.', ' . ']))}"
    if form < 0.45:
        a, b = r.choice(["()", "[]"])
        dot = r.choice([".", f" {a}dot{b} ", f" {a} dot {b} "])
        return f"{local} {r.choice([f'{a}at{b}', f'{a} at {b}'])} {domain.replace('.', dot)}"
    if form < 0.52:
        return f"{local} at {domain.replace('.', ' dot ')}"
    return f"{local}@{domain}"


def _name(r: random.Random, given: list[str], family: list[str]) -> str:
    g, f, m = r.choice(given), r.choice(family), r.choice(_LETTERS)
    return r.choice([f"{g} {f}", f"{g} {f}", f"{f} , {g}", f"{f}, {g}", f"{g} {m}. {f}", f"{m}. {f}", f"{m} . {f}", f"{g} {f} Jr.", f"{g} {f} {r.choice(['II', 'III'])}", f"{g} {r.choice(['de', 'von', 'al'])} {f}", f])


def _augmented(r: random.Random, text: str, spans: list[tuple[int, int, str]], towns: list[str], words: list[str], people: tuple[list[str], list[str]] = ([], [])) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with a few snippets written into it, and the spans of all."""
    town, word = (lambda: r.choice(towns)), (lambda: r.choice(words))
    for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
        free = [m.start() for m in re.finditer(r"(?<=\S) ", text) if not any(s < m.start() < e for s, e, _ in spans)]
        at = r.choice(free) if free and r.random() < 0.8 else len(text)
        kind = r.choice(["PHONE", "PHONE", "ID", "ID", "ADDRESS", "ADDRESS", "EMAIL", "EMAIL", *["NAME", "NAME"] * bool(people[0] and people[1]), None, None, None])
        if kind == "PHONE":
            cue, value = r.choice(_PHONE_CUES), _filled(r, r.choice(_PHONES))
        elif kind == "ID":
            cue, form = r.choice(_IDS)
            value = _filled(r, form)
        elif kind == "ADDRESS":
            cue, value = r.choice(_HOME_CUES), _street(r, town)
        elif kind == "EMAIL":
            cue, value = r.choice(_MAIL_CUES), _mail(r, word)
        elif kind == "NAME":
            cue, value = r.choice(_NAME_CUES), _name(r, *people)
        else:
            cue, value = "", _filled(r, r.choice(_NEITHER)).replace("{w}", word()).replace("{w}", word()).replace("{t}", town())
        if kind and r.random() < 0.3:
            value = re.sub(r"([-+()])", r" \1 ", value) if kind in ("PHONE", "ID") else value
            value = re.sub(r" +", " ", value).strip()
        if kind and r.random() < 0.5:
            value = value.replace(" , ", ", ")
        open_, close = r.choice([(" ( ", " )"), (" (", ")"), (" , ", " ,"), (", ", ","), (" ", "")])
        head = open_ + (cue + " " if cue else "")
        snippet = head + value + close
        spans = [(s + len(snippet) * (s >= at), e + len(snippet) * (s >= at), k) for s, e, k in spans]
        if kind:
            spans.append((at + len(head), at + len(head) + len(value), kind))
        text = text[:at] + snippet + text[at:]
    if r.random() < 0.12:
        low = text.lower() if r.random() < 0.7 else text.upper()
        text = low if len(low) == len(text) else text
    return text, spans


def _tagged(tokens: list[str], tags: list[str]) -> tuple[str, list[tuple[int, int, str]]] | None:
    """The joined tokens and the spans of their tags; None where the tags can't be trusted."""
    if tokens is None or tags is None or len(tokens) != len(tags) or not len(tokens):
        return None
    text, spans, at, open_ = [], [], 0, None
    for token, tag in zip(tokens, tags):
        token = token or ""
        if tag not in ("O", "B-PER", "I-PER", "B-EMAIL", "I-EMAIL"):
            return None
        kind = {"PER": "NAME", "EMAIL": "EMAIL"}.get(tag[2:])
        if tag[0] == "B":
            open_ = [at, at + len(token), kind]
            spans.append(open_)
        elif tag[0] == "I":
            if open_ is None or open_[2] != kind:
                return None
            open_[1] = at + len(token)
        else:
            open_ = None
        text.append(token)
        at += len(token) + 1
    return " ".join(text), [tuple(x) for x in spans]


class Detector:
    """The fitted models; travels to the executors by value."""

    def __init__(self):
        self.statistics = Statistics()
        self.models: dict[str, BoostedTrees] = {}
        self.held_out: dict[str, float] = {}

    def fit(self, rows: list[tuple[str, list[tuple[int, int, str]]]], given: set[str], family: set[str], seed: int = 11) -> Detector:
        """rows: tagged texts; a third each for the statistics, the trees and the thresholds."""
        r = random.Random(seed)
        towns = sorted({m[1] for t, _ in rows for m in re.finditer(r"\b(?:in|at|of|near) ([A-Z][a-z]{4,})\b", t)}) or ["Northby", "Eastham"]
        words = sorted({w.lower() for t, spans in rows for s, e, k in spans if k == "NAME" for w in re.findall(r"[A-Za-z]{3,}", t[s:e])}) or ["alex", "kim"]
        people = (sorted(w.title() for w in given), sorted(w.title() for w in family))
        parts: list[list] = [[], [], []]
        for n, (text, spans) in enumerate(rows):
            text, spans = _augmented(r, text, spans, towns, words, people)
            parts[n % 3].append((Pieces(text), spans))
        self.statistics.fit(parts[0], given, family)
        for kind in KINDS:
            fit = [self._labelled(kind, p, spans) for p, spans in parts[1]]
            x = np.array([f for a, _, _ in fit for f in a], float)
            y = np.array([v for _, b, _ in fit for v in b], float)
            if not len(x) or not y.any():
                continue
            if len(x) > FIT_SPANS:
                keep = np.sort(np.random.default_rng(seed).permutation(len(x))[:FIT_SPANS])
                x, y = x[keep], y[keep]
            model = BoostedTrees().fit(x, y)
            held = [self._labelled(kind, p, spans) for p, spans in parts[2]]
            hx = np.array([f for a, _, _ in held for f in a], float)
            hy = np.array([v for _, b, _ in held for v in b], float)
            if len(hx):
                self.held_out[kind] = model.calibrate(model.predict(hx), hy, sum(m for _, _, m in held))
            self.models[kind] = model
        return self

    def _candidates(self, kind: str, p: Pieces) -> tuple[list[tuple[int, int]], list[list[float]]]:
        if kind == "NAME":
            p.mark(self.statistics.common, self.statistics.never)
            found = list(dict.fromkeys(_name_spans(p)))
            return [(p.spans[i][0], p.spans[j][1]) for i, j in found], [self.statistics.features(p, i, j) for i, j in found]
        if kind == "EMAIL":
            spans = list(dict.fromkeys(_email_spans(p.text)))
        elif kind == "ADDRESS":
            spans = list(dict.fromkeys(_address_spans(p.text)))
        else:
            spans = list(dict.fromkeys(_number_spans(p.text, NUMBER if kind == "PHONE" else CODE)))
            spans = [(s, s + len(p.text[s:e].rstrip())) for s, e in spans]
        return spans, [span_features(p, s, e) for s, e in spans]

    def _labelled(self, kind: str, p: Pieces, spans: list[tuple[int, int, str]]) -> tuple[list, list, int]:
        found, x = self._candidates(kind, p)
        gold = {(s, e) for s, e, k in spans if k == kind}
        return x, [float(f in gold) for f in found], len(gold - set(found))

    def detect_all(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Non-overlapping (start, end, kind) of each text, in order."""
        pieces = [Pieces(t) for t in texts]
        chosen: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        for kind, model in self.models.items():
            each = [self._candidates(kind, p) for p in pieces]
            x = [f for _, a in each for f in a]
            if not x:
                continue
            score = model.predict(np.array(x, float))
            at = 0
            for n, (found, _) in enumerate(each):
                for s, e in found:
                    if score[at] >= model.threshold:
                        # contact data wins over names, then score, then length
                        chosen[n].append((-float(kind != "NAME"), -round(float(score[at]), 3), s - e, s, e, kind))
                    at += 1
        out = []
        for options in chosen:
            taken: list[tuple[int, int, str]] = []
            for *_, s, e, kind in sorted(options):
                if all(e <= a or s >= b for a, b, _ in taken):
                    taken.append((s, e, kind))
            out.append(sorted(taken))
        return out


def trained(train: DataFrame, names: DataFrame, rows: int = SAMPLE_ROWS) -> Detector:
    """Fits a detector on ``rows`` rows of the labelled split and the list of name words (fixed size)."""
    # the rows of the smallest hashes: a share of the hash range that should hold them, wider if it does not
    n, share = train.count(), 1.3
    of_hash = F.xxhash64("idx")
    labelled = train.where(F.col("idx").isNotNull() & (F.size("tokens") > 0)).select("idx", "tokens", "ner_tags", of_hash.alias("h"))
    while True:
        part = share * rows / max(n, 1)
        sample = (labelled if part >= 1 else labelled.where(F.col("h") < F.lit(int(-(2**63) + part * 2**64)))).toPandas()  # about share * rows rows
        sample = sample.drop_duplicates("idx")
        if len(sample) >= rows or part >= 1:
            break
        share *= 4
    sample = sample.sort_values(["h", "idx"])[:rows].sort_values("idx")
    tagged = [x for x in map(_tagged, sample["tokens"], sample["ner_tags"]) if x]
    parts = names.where(F.col("name_part").isNotNull()).toPandas()
    of = lambda kind: {w for x in parts.loc[parts["part_kind"] == kind, "name_part"] for w in _WORD.findall(x.lower())}
    return Detector().fit(tagged, of("given"), of("family"))


# ---------------------------------------------------------------- the operator


def _key(value: str) -> str:
    return "".join(_WORD.findall(value.lower()))


def _joined(tokens) -> str:
    return "" if tokens is None else " ".join(t or "" for t in tokens)


def _spans_of(d: Detector, *columns: list[str]) -> dict[str, list[tuple[int, int, str]]]:
    """The spans of every distinct text; many rows have the same text in both fields."""
    texts = list(dict.fromkeys(t for c in columns for t in c))
    return dict(zip(texts, d.detect_all(texts)))


def _found(detector):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pickle.loads(detector.value)
        for b in batches:
            fields = {"sequence": b["sequence"].fillna("").tolist(), "tokens": [_joined(x) for x in b["tokens"]]}
            spans = _spans_of(d, *fields.values())
            rows = {(idx, field, kind, _key(t[s:e])) for field, texts in fields.items() for idx, t in zip(b["idx"].tolist(), texts) for s, e, kind in spans[t]}
            yield pd.DataFrame(list(rows), columns=["idx", "field", "kind", "value_key"])

    return run


def _masked(tokens, spans: list[tuple[int, int, str]]) -> list[str]:
    """The tokens with each span as one placeholder; what a token holds around a span stays."""
    out, at, k = [], 0, 0
    for token in tokens:
        token = token or ""
        start, end = at, at + len(token)
        at = end + 1
        kept, cursor = "", start
        while k < len(spans) and spans[k][0] < end:
            s, e, kind = spans[k]
            if s >= start:
                kept += token[cursor - start : s - start] + f"[{kind}]"
            cursor = min(e, end)
            if e <= end:
                k += 1
            else:
                break
        kept += token[cursor - start :]
        if kept or not token:
            out.append(kept)
    return out


def _redacted(detector):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pickle.loads(detector.value)
        for b in batches:
            texts, lists = b["sequence"].fillna("").tolist(), [None if x is None else list(x) for x in b["tokens"]]
            joined = [_joined(x) for x in lists]
            found = _spans_of(d, texts, joined)
            masked = []
            for text, raw in zip(texts, b["sequence"]):
                parts, at = [], 0
                for s, e, kind in found[text]:
                    parts += [text[at:s], f"[{kind}]"]
                    at = e
                masked.append(None if raw is None else "".join(parts) + text[at:])
            tokens = [None if x is None else _masked(x, found[t]) for x, t in zip(lists, joined)]
            yield pd.DataFrame({"idx": b["idx"], "sequence": masked, "tokens": tokens})

    return run


def _inputs(spark: SparkSession, sf_dir: str):
    detector = trained(table(spark, sf_dir, "train_injected"), table(spark, sf_dir, "name_parts"))
    rows = table(spark, sf_dir, "test_injected").where(F.col("idx").isNotNull()).select("idx", "sequence", "tokens")
    # by value, so a worker needs no copy of the package
    return spark.sparkContext.broadcast(cloudpickle.dumps(detector)), rows


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, field, kind, value_key): each distinct value found in the two fields of a test row."""
    detector, rows = _inputs(spark, sf_dir)
    return rows.mapInPandas(_found(detector), "idx long, field string, kind string, value_key string").where("value_key <> ''").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, sequence, tokens): both fields with typed placeholders, all else unchanged."""
    detector, rows = _inputs(spark, sf_dir)
    return rows.mapInPandas(_redacted(detector), "idx long, sequence string, tokens array<string>").dropDuplicates(["idx"])
