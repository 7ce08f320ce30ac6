"""Problem 1: the same or nearly the same records across splits.

A pair (train, evaluation) is a case when the word-level edit distance of the two texts is at most
0.2 times the words of the longer one.  Every text becomes a string with one code point for each
word, so automata and edit distances work on words.

An evaluation text of m words can differ from a partner in at most floor(m/4) words, so of
floor(m/4) + 1 disjoint passages one survives unchanged in every partner.  The passages tile the
text, and each has an anchor, its rarest word within reach of both ends; cuts are where the sum of
the chances of passages and anchors (by counts over all training texts) is least.  Passages and the
windows of the training texts around the same words are sharded by that word; each shard builds one
Aho-Corasick automaton over its passages and scans its windows.  A match counts when lengths and
positions allow the pair and when the parity signatures of the two bags of words differ in no more
bits than the allowed edits can cause.  An edit breaks one passage at most, so a pair that may
differ in d words is a candidate only with floor(m/4) + 1 - d matched passages; matched intervals
are merged into the coverage of the evaluation record, and an exact edit distance decides.

A window is only sent where a bitmap of fixed size may hold one of the sixteen passages around its
middle word, which is exact, so the automata see all of the training texts that can matter.  Each
shard is read as a stream: its passages first, then its windows in batches, so a task holds the
passages of one shard and one batch.

Equal texts are one class on either side, named by the first hash of their words; only texts whose
hashes may be repeated are moved for it, and they are expanded only in the pairs that come out.
The code space bounds every table that is sent to the executors.  A word in many training windows or
many passages (over ``HOT_WINDOWS``) is spread over a grid of shards: each window goes to one row of the
grid, each passage to one column.  Two words share a code point with probability 1e-6, which can only make texts seem
nearer; the pairs that are left are confirmed on the words themselves.

Defined cases: null and empty texts, and texts without any letter or digit, are never cases;
repeated rows of one id count once; an empty table gives no pairs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.bitmaps import BLOCK_BITS, hash_filter, packed
from tagloom.plans.staging import stage, table

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Code points from FIRST on, without the surrogates: one for each hash value of a word.
FIRST, SURROGATES = 0x20, 0x800
CODES = 0x110000 - SURROGATES - FIRST
REACH = 3
WIDTH = 2 * REACH + 2
PAD = "\x01"
HOT_WINDOWS = 200_000
SHARD_WINDOWS = 250_000
PAIRS_AT_ONCE = 2_000_000
#: Passages and windows are written in a smaller alphabet of two-byte letters; it only admits candidates.
LETTERS = 1900
#: Texts are cut block by block, so that the work grows in proportion to their words; BLOCK / 4 passages each.
BLOCK, BLOCKS_AT_ONCE = 64, 2000
#: Log of the chance of a word that no training text has.
NEVER = -100.0
#: Weight of the chance of an anchor beside that of its passage: where the bitmap is full, every use of an anchor is a window.
ANCHOR = 0.01
#: Multipliers of the words of a passage by their distance from the anchor, and terms for how far it reaches.
_MIX = np.arange(1, WIDTH * (WIDTH + 1), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MIX = (_MIX ^ _MIX >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
TIMES_OF, SHAPE = _MIX[: 2 * REACH + 1], _MIX[2 * REACH + 1 :]
#: Bits of the table of passages: ``BITS_EACH`` for each passage, between these bounds (32 MB at most).
BITS_LEAST, BITS_MOST, BITS_EACH = 1 << 22, 1 << 28, 16
#: Bits set for each passage, for a window asks for sixteen.
PROBES = 3
#: Bits of the filters of class ids ahead of joins.
ID_BITS = 1 << 22
TIMES = 5  # at most one edit for every TIMES words of the longer text


class _Codes(dict):
    def __missing__(self, word: str) -> str:
        code = FIRST + zlib.crc32(word.encode("utf-8", "surrogatepass")) % CODES
        self[word] = char = chr(code if code < 0xD800 else code + SURROGATES)
        if len(self) > 2_000_000:
            self.clear()
        return char


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = _Codes()
    for b in batches:
        words = [" ".join(WORD.findall(t.lower())) for t in b["sequence"]]
        code = ["".join(map(codes.__getitem__, w.split(" "))) if w else "" for w in words]
        out = pd.DataFrame({"idx": b["idx"], "code": code, "words": words})
        yield out[out["code"] != ""]


def encoded(df: DataFrame) -> DataFrame:
    """(idx, code, words, h1, h2) of the rows that have a word; ``words`` are joined by blanks, the hashes are theirs."""
    rows = df.where(F.col("idx").isNotNull() & (F.col("sequence") != "")).select("idx", "sequence").mapInPandas(_encode, "idx long, code string, words string")
    return rows.select("*", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), F.reverse("words")).alias("h2"))


def classes(enc: DataFrame, name: str) -> DataFrame:
    """(cls, code, words, h2) of the distinct texts; ``cls`` is h1.  Only hashes are shuffled, and the texts whose h1 may be repeated."""
    may = hash_filter(enc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h1", ID_BITS)
    rows = enc.select(F.col("h1").alias("cls"), "code", "words", "h2")
    repeated = stage(rows.where(may(F.col("cls"))).dropDuplicates(["cls", "h2"]), name)
    return rows.where(~may(F.col("cls"))).unionByName(repeated)


def _points(code: str) -> np.ndarray:
    """The hash values of a code string."""
    x = np.frombuffer(code.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(x > 0xDFFF, x - SURROGATES, x) - FIRST


def _letters(points: np.ndarray) -> str:
    return (points % LETTERS + 0x80).astype(np.uint32).tobytes().decode("utf-32-le")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: np.ndarray | None = None
    for b in batches:
        if len(b):
            total = np.zeros(CODES, np.int64) if total is None else total
            total += np.bincount(_points("".join(b["code"])), minlength=CODES)
    if total is not None:
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": total[at]})


def word_counts(cls: DataFrame) -> np.ndarray:
    """Uses of each code in all texts of ``cls``; at most ``CODES`` rows come to the driver."""
    rows = cls.select("code").mapInPandas(_count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CODES, np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _signatures(points: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row, the parity of 64 groups of its words."""
    out = np.zeros(rows, np.uint64)
    np.bitwise_xor.at(out, row, np.left_shift(np.uint64(1), ((points * 2654435761 >> 7) & 63).astype(np.uint64)))
    return out.view(np.int64)


def _sums(points: np.ndarray, at: np.ndarray, way: int) -> np.ndarray:
    """Sums over the next 0, 1, ... ``REACH`` words before (``way`` -1) or behind the places ``at``, one row for each number."""
    out = np.zeros((REACH + 1, len(at)), np.uint64)
    for k in range(1, REACH + 1):
        i = np.clip(at + way * k, 0, len(points) - 1)
        out[k] = out[k - 1] + (points[i] + 1).astype(np.uint64) * TIMES_OF[REACH + way * k]
    return out


def _keys(before: np.ndarray, anchor: np.ndarray, behind: np.ndarray, shape, bits: int) -> np.ndarray:
    """Keys of passages in the bitmap: a block over ``PROBES`` places in it."""
    h = before + behind + (anchor + 1).astype(np.uint64) * TIMES_OF[REACH] + SHAPE[shape]
    for x in (0x94D049BB133111EB, 0xD6E8FEB86659FD93):
        h = (h ^ h >> np.uint64(32)) * np.uint64(x)
    return ((h ^ h >> np.uint64(32)) & np.uint64((bits << BLOCK_BITS * (PROBES - 1)) - 1)).astype(np.int64)


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the bitmap may hold."""
    i = np.arange(len(keys))
    for k in range(PROBES):
        place = keys >> BLOCK_BITS * PROBES << BLOCK_BITS | keys >> BLOCK_BITS * k & (1 << BLOCK_BITS) - 1
        hit = (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        i, keys = i[hit], keys[hit]
    return i


def _cuts(chance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of ``k`` passages of at most ``WIDTH - 1`` words that tile texts of one length, (k, texts) each.

    chance: the log of the chance of each word, (words, texts).  The sum of the passages' chances and of ``ANCHOR`` times
    those of their anchors is the least possible.
    """
    m, texts = chance.shape
    total = np.vstack([np.zeros((1, texts)), np.cumsum(chance, 0)])
    best, size = np.full((m + 1, k + 1, texts), np.inf), np.zeros((m + 1, k + 1, texts), np.int8)
    best[0, 0] = 0
    most = WIDTH - 1
    for y in range(1, m + 1):
        # as many passages as the words up to here and those that follow can have
        lo, hi = max(1, -(-y // most), k - (m - y)), min(k, y, k - -(-(m - y) // most))
        for x in range(max(0, y - most), y):
            anchor = chance[max(x, y - REACH - 1) : min(y, x + REACH + 1)].min(0)
            new = best[x, lo - 1 : hi] + (np.exp(total[y] - total[x]) + ANCHOR * np.exp(anchor))
            less = new < best[y, lo : hi + 1]
            best[y, lo : hi + 1] = np.where(less, new, best[y, lo : hi + 1])
            size[y, lo : hi + 1] = np.where(less, y - x, size[y, lo : hi + 1])
    ends, y, at = np.zeros((k, texts), np.int64), np.full(texts, m), np.arange(texts)
    starts = np.zeros_like(ends)
    for j in range(k, 0, -1):
        ends[j - 1] = y
        starts[j - 1] = y = y - size[y, j, at]
    return starts, ends


def passages_of(points: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor) of the floor(m/4) + 1 disjoint passages of each text; places are those in ``points``, in which texts of ``n`` words follow each other."""
    used = counts[points].astype(np.int64)
    chance = np.where(used > 0, np.log(np.maximum(used, 1) / max(int(counts.sum()), 1)), NEVER)
    blocks = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(n) - n)[text] + nth * BLOCK
    last = nth == blocks[text] - 1
    size = np.where(last, n[text] - nth * BLOCK, BLOCK)
    parts = []
    for kind in np.unique(size * 2 + last):
        m, k = int(kind >> 1), int(kind >> 1) // 4 + int(kind & 1)
        of_kind = np.flatnonzero(size * 2 + last == kind)
        for i in np.split(of_kind, range(BLOCKS_AT_ONCE, len(of_kind), BLOCKS_AT_ONCE)):
            starts, ends = _cuts(chance[begin[i] + np.arange(m)[:, None]], k)
            parts.append(np.stack([np.broadcast_to(text[i], starts.shape), starts + begin[i], ends + begin[i]]).reshape(3, -1))
    text, start, end = np.concatenate(parts, axis=1)
    # the rarest word from which both ends are within reach
    least, most = np.maximum(start, end - REACH - 1), np.minimum(end - 1, start + REACH)
    at = least + np.arange(REACH + 1)[:, None]
    anchor = least + np.argmin(np.where(at <= most, used[np.minimum(at, most)], np.iinfo(np.int64).max), axis=0)
    return text, start, end, anchor


def _shard(point: np.ndarray, salt: np.ndarray, column: np.ndarray, shards: int) -> np.ndarray:
    return ((point * 40503 + salt * 2654435761 + column * 805459861) & 0x7FFFFFFF) % shards


def _flat(codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash values of the words of all texts, the number of words of each text, and the text of each word."""
    n = np.array([len(c) for c in codes])
    return _points("".join(codes)), n, np.repeat(np.arange(len(codes)), n)


def _passages(counts, salts, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_of, salts_of = counts.value, salts.value
        for b in batches:
            if not len(b):
                continue
            points, n, row = _flat(b["code"].tolist())
            text, start, end, at = passages_of(points, n, n_of)
            unseen = np.concatenate([[0], np.cumsum(n_of[points] == 0)])
            known = unseen[start] == unseen[end]  # a word that no training text has cannot be in a match
            text, start, end, at = text[known], start[known], end[known], at[known]
            i, left, right = np.arange(len(at)), at - start, end - 1 - at
            mid = _keys(_sums(points, at, -1)[left, i], points[at], _sums(points, at, 1)[right, i], left * WIDTH + right, bits)
            wide = salts_of[points[at]]
            i = np.repeat(i, wide)
            salt = np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide)
            letters, t = _letters(points), text[i]
            yield pd.DataFrame({
                "anchor": points[at][i].astype(np.int32), "salt": salt.astype(np.int32), "mid": mid[i], "ecls": b["cls"].to_numpy()[t],
                "passage": [letters[x:y] for x, y in zip(start[i].tolist(), end[i].tolist())], "lo": (start[i] - (np.cumsum(n) - n)[t]).astype(np.int32),
                "off": left[i].astype(np.int32), "m": n[t].astype(np.int32), "sig": _signatures(points, row, len(n))[t],
            })

    return run


#: Windows and passages of a shard in one form: passages (role 0) come before windows (role 1).
ROWS = "shard int, role int, cls long, at long, sig long, text string"


def _windows(bitmap, bits: int, columns, salts, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may_be, columns_of, salts_of = bitmap.value, columns.value, salts.value
        for b in batches:
            if not len(b):
                continue
            codes = b["code"].tolist()
            points, n, row = _flat(codes)
            pos = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
            keep = np.flatnonzero(columns_of[points])
            r, q, p = row[keep], pos[keep], points[keep]
            before, behind, rest = _sums(points, keep, -1), _sums(points, keep, 1), n[r] - 1 - q
            may = np.zeros(len(keep), bool)
            for x in range(REACH + 1):
                for y in range(REACH + 1):
                    i = np.flatnonzero(~may & (q >= x) & (rest >= y))
                    may[i[_held(may_be, _keys(before[x, i], p[i], behind[y, i], x * WIDTH + y, bits))]] = True
            r, q, p = r[may], q[may], p[may]
            wide = columns_of[p]  # one copy for each column of the word's grid
            column = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            r, q, p = np.repeat(r, wide), np.repeat(q, wide), np.repeat(p, wide)
            gap = PAD * REACH
            letters, ends = _letters(points), np.cumsum(n).tolist()
            padded = [gap + letters[e - k : e] + gap for e, k in zip(ends, n.tolist())]
            cls = b["cls"].to_numpy()[r]
            yield pd.DataFrame({
                "shard": _shard(p, cls % salts_of[p], column, shards).astype(np.int32), "role": np.ones(len(r), np.int32), "cls": cls, "at": q << 32 | n[r],
                "sig": _signatures(points, row, len(codes))[r],
                "text": [padded[i][x : x + 2 * REACH + 1] for i, x in zip(r.tolist(), q.tolist())],
            })

    return run


MATCH = "tcls long, ecls long, lo int, hi int, m int, need int"


class _Automaton:
    """The passages of one shard."""

    def __init__(self, parts: list[pd.DataFrame]):
        import ahocorasick

        pas = pd.concat(parts, ignore_index=True)
        # ``at`` holds (lo, off, m); the offset of the anchor is part of a passage, for it must fall on the middle of the window
        at = pas["at"].to_numpy()
        lo, off, m = at >> 36, at >> 32 & 15, at & 0xFFFFFFFF
        keys, distinct = pd.factorize(pas["text"])
        order = np.lexsort((m, off, keys))
        self.lo, self.off, self.m = lo[order], off[order], m[order]
        self.cls, self.sig, keys = pas["cls"].to_numpy()[order], pas["sig"].to_numpy()[order], keys[order]
        self.length = np.array([len(x) for x in distinct])
        self.span = self.length[keys]
        # passages of one text and offset, by the length of their records
        group = keys.astype(np.int64) * WIDTH + self.off
        self.by_length = group << 32 | self.m
        self.groups = np.unique(group)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, text in enumerate(distinct):
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()

    def matches(self, win: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Hits of a batch of windows, in blocks of about ``PAIRS_AT_ONCE`` pairs."""
        hits = np.fromiter((x for hit in self.automaton.iter(PAD.join(win["text"]) + PAD) for x in hit), np.int64).reshape(-1, 2)
        if not len(hits):
            return
        w = hits[:, 0] // WIDTH
        off = REACH - (hits[:, 0] % WIDTH - self.length[hits[:, 1]] + 1)
        g = hits[:, 1] * WIDTH + off
        at = np.minimum(np.searchsorted(self.groups, g), len(self.groups) - 1)
        ok = (off >= 0) & (self.groups[at] == g)
        w, g = w[ok], g[ok]
        tcls, tsig, place = (win[c].to_numpy() for c in ("cls", "sig", "at"))
        pos, n = place >> 32, place & 0xFFFFFFFF
        # only records whose length allows a pair
        first = np.searchsorted(self.by_length, g << 32 | n[w] - n[w] // TIMES)
        size = np.searchsorted(self.by_length, g << 32 | n[w] * TIMES // (TIMES - 1), side="right") - first
        w, first, size = w[size > 0], first[size > 0], size[size > 0]
        total = np.cumsum(size)
        start = 0
        while start < len(w):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, side="right")))
            s = size[start:end]
            i = np.repeat(w[start:end], s)
            j = np.repeat(first[start:end], s) + np.arange(len(i)) - np.repeat(np.cumsum(s) - s, s)
            d = np.maximum(n[i], self.m[j]) // TIMES
            near = (np.abs(n[i] - self.m[j]) <= d) & (np.abs(pos[i] - self.lo[j] - self.off[j]) <= d)
            fits = (np.bitwise_count((tsig[i] ^ self.sig[j]).view(np.uint64)) <= 2 * d) & near
            i, j, need = i[fits], j[fits], (self.m[j] // 4 + 1 - d)[fits]
            yield pd.DataFrame({
                "tcls": tcls[i], "ecls": self.cls[j], "lo": self.lo[j].astype(np.int32), "hi": (self.lo + self.span)[j].astype(np.int32), "m": self.m[j].astype(np.int32),
                "need": need.astype(np.int32),
            })
            start = end


def _matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by shard, passages before windows: an automaton over the passages of a shard scans its windows as they come."""
    shard, parts, automaton = None, [], None
    for b in batches:
        cuts = np.flatnonzero(np.diff(b["shard"].to_numpy()) | np.diff(b["role"].to_numpy())) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            if x == y:
                continue
            rows = b.iloc[x:y]
            if rows["shard"].iat[0] != shard:
                shard, parts, automaton = rows["shard"].iat[0], [], None
            if rows["role"].iat[0] == 0:
                parts.append(rows)
            elif parts:
                automaton = automaton or _Automaton(parts)
                yield from automaton.matches(rows)


def _merged(intervals):
    """Words in the union of sorted intervals [lo, hi)."""
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end")
    )
    return F.aggregate(F.array_sort(intervals), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])


def _distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, or ``most + 1`` beyond it: rows of the table within ``most`` of the diagonal."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    far = most + 1
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = new
    return min(row[len(b)], far)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Takes the distance of the pairs in which two different words share a code point from their words."""
    for b in batches:
        a, c = b["twords"].str.split(" "), b["ewords"].str.split(" ")
        shared = [len({*x, *y}) != len({*p, *q}) for x, y, p, q in zip(a, c, b["tcode"], b["ecode"])]
        distance = [_distance(x, y, max(len(x), len(y)) // TIMES) if s else d for x, y, s, d in zip(a, c, shared, b["distance"])]
        b = b.assign(distance=distance)
        yield b.loc[[d <= max(len(x), len(y)) // TIMES for d, x, y in zip(distance, a, c)], ["t1", "t2", "e1", "e2", "coverage", "distance"]]


def overlapping_classes(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(t1, t2, e1, e2, coverage, distance) of the pairs of classes, named by hashes of their words; train and evaluation: (cls, code, words, h2)."""
    sc = train.sparkSession.sparkContext
    counts = word_counts(train)
    salts = np.maximum(1, -(-counts // HOT_WINDOWS)).astype(np.int32)
    b_counts, b_salts = sc.broadcast(counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64)), sc.broadcast(salts)
    # one passage for each four words begun
    many = evaluation.agg(F.sum(F.floor(F.length("code") / 4) + 1).alias("n")).first().n or 0
    bits = int(min(max(BITS_LEAST, 1 << (int(many) * BITS_EACH).bit_length()), BITS_MOST))
    passages = stage(
        evaluation.select("cls", "code").mapInPandas(_passages(b_counts, b_salts, bits), "anchor int, salt int, mid long, ecls long, passage string, lo int, off int, m int, sig long"),
        "p1-passages",
    )
    uses = passages.where("salt = 0").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most CODES rows
    columns = np.zeros(CODES, np.int64)
    columns[uses["anchor"].to_numpy(np.int64)] = -(-uses["n"].to_numpy(np.int64) // HOT_WINDOWS)
    bitmap = packed(passages.select(F.col("mid").alias("at")), bits, PROBES)
    shards = int((counts * columns).sum() // SHARD_WINDOWS) + 2 * sc.defaultParallelism
    windows = train.select("cls", "code").mapInPandas(_windows(sc.broadcast(bitmap), bits, sc.broadcast(columns), b_salts, shards), ROWS)
    wide = F.create_map(*[F.lit(x) for at in np.flatnonzero(columns > 1).tolist() for x in (at, int(columns[at]))]) if (columns > 1).any() else None
    column = F.lit(0) if wide is None else F.pmod(F.col("ecls"), F.coalesce(F.try_element_at(wide, F.col("anchor")), F.lit(1)))
    mixed = F.col("anchor").cast("long") * 40503 + F.col("salt").cast("long") * 2654435761 + column.cast("long") * 805459861
    long = lambda c: F.col(c).cast("long")
    placed = passages.select(
        (mixed.bitwiseAND(0x7FFFFFFF) % shards).cast("int").alias("shard"), F.lit(0).alias("role"), F.col("ecls").alias("cls"),
        (F.shiftleft(long("lo"), 36) + F.shiftleft(long("off"), 32) + long("m")).alias("at"), "sig", F.col("passage").alias("text"),
    )
    # a partition for each shard, so the work of a task does not grow with the input
    rows = windows.unionByName(placed).repartition(shards, "shard").sortWithinPartitions("shard", "role")
    hits = rows.mapInPandas(_matches, MATCH)
    met = hits.groupBy("tcls", "ecls").agg(F.max("m").alias("m"), F.min("need").alias("need"), F.collect_set(F.struct("lo", "hi")).alias("met"))
    pairs = stage(met.where(F.size("met") >= F.col("need")).select("tcls", "ecls", "m", _merged(F.col("met")).alias("covered")), "p1-candidates")
    # only the classes of candidates are moved
    may_t, may_e = hash_filter(pairs, "tcls", ID_BITS), hash_filter(pairs, "ecls", ID_BITS)
    t = train.where(may_t(F.col("cls"))).select(F.col("cls").alias("tcls"), F.col("code").alias("tcode"), F.col("words").alias("twords"), F.col("h2").alias("t2"))
    e = evaluation.where(may_e(F.col("cls"))).select(F.col("cls").alias("ecls"), F.col("code").alias("ecode"), F.col("words").alias("ewords"), F.col("h2").alias("e2"))
    most = F.floor(F.greatest(F.length("tcode"), F.length("ecode")) / TIMES).cast("int")
    near = t.join(e.join(pairs, "ecls"), "tcls").withColumn("distance", F.levenshtein("tcode", "ecode")).where(F.col("distance") <= most)
    near = near.withColumn("coverage", F.round(F.col("covered") / F.col("m"), 6)).withColumnsRenamed({"tcls": "t1", "ecls": "e1"})
    near = near.select("t1", "t2", "e1", "e2", "tcode", "ecode", "twords", "ewords", "coverage", "distance")
    return near.mapInPandas(_confirm, "t1 long, t2 long, e1 long, e2 long, coverage double, distance int")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx_t, idx_e, coverage, distance), each pair of ids once."""
    train = stage(encoded(table(spark, sf_dir, "train_injected")), "p1-train")
    evaluation = stage(
        encoded(table(spark, sf_dir, "val_injected")).unionByName(encoded(table(spark, sf_dir, "test_injected"))), "p1-eval"
    )
    found = stage(overlapping_classes(classes(train, "p1-train-classes"), classes(evaluation, "p1-eval-classes")), "p1-pairs")
    of = lambda df, c: df.select(F.col("idx").alias(f"idx_{c}"), F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"))
    named = found.join(of(evaluation, "e").distinct(), ["e1", "e2"]).drop("e1", "e2")
    return named.join(of(train, "t"), ["t1", "t2"]).drop("t1", "t2").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx_a, idx_b): the pairs of a train row and a val or test row, smaller id first."""
    p = _pairs(spark, sf_dir)
    return p.select(F.least("idx_t", "idx_e").alias("idx_a"), F.greatest("idx_t", "idx_e").alias("idx_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, source_dataset, n_pairs, n_records, mean_coverage) of the evaluation records that overlap train."""
    p = _pairs(spark, sf_dir)
    of = lambda t, s: table(spark, sf_dir, t).select(F.col("idx").alias("idx_e"), F.lit(s).alias("split"), "source_dataset").dropDuplicates(["idx_e"])
    return (
        p.join(of("val_injected", "val").unionByName(of("test_injected", "test")), "idx_e")
        .groupBy("split", "source_dataset")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("idx_e").alias("n_records"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    )
