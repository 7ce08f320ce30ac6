"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import bpe, layout, lookalike, overlap, packing, ranking, redaction, sampling, truncation
from tagloom.llm.boosting import BoostedTrees

SPLIT = (
    "idx long, lang string, source_dataset string, sequence string, tokens array<string>, ner_tags array<string>, n_tokens int, n_per_spans int, n_email_spans int, "
    "entity_density_bucket string, loaded_at timestamp, code string, cls long, token string, form string, needed string, rank long, id long, text string, available long"
)


def rows(spark, items):
    """Split rows from partial dicts; the other columns, clashing names included, are null."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SPLIT)
    return spark.createDataFrame([tuple(i.get(f.name) for f in schema) for i in items], schema)


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# ---------------------------------------------------------------- problem 1


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_overlap_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(1, 40))] for _ in range(60)]

    def changed(w):
        w = list(w)
        for _ in range(r.randint(0, max(1, len(w) // 4))):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 1)
        return w

    train = [(i, " ".join(changed(r.choice(base)))) for i in range(150)] + [(200, None), (201, ""), (202, " , ! "), (203, "Same Text, here"), (203, "Same Text, here")]
    other = [(1000 + i, " , ".join(changed(r.choice(base))).upper()) for i in range(120)] + [(2000, None), (2001, ""), (2002, " ; "), (2003, "same (text) HERE."), (2004, "x " * 3000)]
    make = lambda xs: rows(spark, [{"idx": i, "sequence": s, "code": "clash", "cls": 1} for i, s in xs])
    d = folder(spark, tmp_path, train_injected=make(train), val_injected=make(other[:60]), test_injected=make(other[60:]))
    words_of = lambda s: overlap.WORD.findall((s or "").lower())
    want = set()
    for i, s in train:
        for j, t in other:
            a, b = words_of(s), words_of(t)
            if a and b and abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and distance(a, b) * 5 <= max(len(a), len(b)):
                want.add((min(i, j), max(i, j)))
    got = [tuple(x) for x in overlap.p1_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (203, 2003) in want
    report = overlap.p1_report(spark, d).collect()
    assert sum(x.n_pairs for x in report) == len(want)


def test_overlap_hot_words_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_WINDOWS", 5)
    make = lambda xs: rows(spark, [{"idx": i, "sequence": s} for i, s in xs])
    d = folder(spark, tmp_path, train_injected=make([(i, f"one hot word {i // 3}") for i in range(40)]), val_injected=make([(100 + i, f"one hot word {i}") for i in range(12)]), test_injected=make([]))
    got = {tuple(x) for x in overlap.p1_found(spark, d).collect()}
    assert got == {(i, 100 + i // 3) for i in range(36)}
    e = folder(spark, tmp_path / "e", train_injected=make([]), val_injected=make([]), test_injected=make([]))
    assert overlap.p1_found(spark, e).count() == 0


def test_words_that_share_a_code(spark, tmp_path):
    """Two words with one code point make a pair look nearer than it is; the words themselves decide."""
    seen, pair = {}, None
    for i in range(20_000):
        code = overlap._Codes()[f"w{i}"]
        if code in seen:
            pair = (seen[code], f"w{i}")
            break
        seen[code] = f"w{i}"
    x, y = pair
    make = lambda xs: rows(spark, [{"idx": i, "sequence": s} for i, s in xs])
    d = folder(
        spark, tmp_path, train_injected=make([(1, f"one two three four five six seven eight {x}"), (2, f"one two three four five six seven {x} nine ten")]),
        val_injected=make([(10, f"one two three four five six seven EIGHT {y}"), (11, f"one two other four five six strange {y} nine ten")]), test_injected=make([]),
    )
    # 1 and 10 differ in one word of nine, 2 and 11 in three of ten, one of which shares its code
    assert {tuple(p) for p in overlap.p1_found(spark, d).collect()} == {(1, 10)}


def test_overlap_moves_only_what_can_matter(spark, tmp_path, monkeypatch):
    """Long records that share one passage are no candidates, and texts that occur once are not shuffled for their classes."""
    staged = {}
    monkeypatch.setattr(overlap, "stage", lambda df, name, stage=overlap.stage: staged.setdefault(name, stage(df, name)))
    r = random.Random(5)
    text = lambda tag: [f"{tag}{r.randrange(400)}" for _ in range(50)] + "one passage of seven words in all".split() + [f"{tag}{r.randrange(400)}" for _ in range(50)]
    train, other = [text("w") for _ in range(30)], [text("w") for _ in range(30)]
    other[3] = [*train[4][:20], "new", "words", *train[4][22:]]
    make = lambda xs, first: rows(spark, [{"idx": first + i, "sequence": " ".join(x)} for i, x in enumerate(xs)])
    d = folder(spark, tmp_path, train_injected=make([*train, train[0]], 0), val_injected=make(other, 100), test_injected=make([], 200))
    assert {tuple(x) for x in overlap.p1_found(spark, d).collect()} == {(4, 103)}
    assert staged["p1-candidates"].count() == 1
    assert staged["p1-train-classes"].count() == 1 and staged["p1-eval-classes"].count() == 0


def test_overlap_passages_tile_texts():
    """floor(m/4) + 1 passages, every word in one of them and within reach of its anchor, in short texts and over several blocks."""
    r = random.Random(6)
    n = np.array([*range(1, 40), 63, 64, 65, 127, 128, 129, 1000])
    points = np.array([r.randrange(200) for _ in range(n.sum())])
    counts = np.zeros(overlap.CODES, np.int32)
    counts[:150] = [r.randrange(1, 1000) for _ in range(150)]  # the others occur in no training text
    text, start, end, anchor = overlap.passages_of(points, n, counts)
    for i, (m, first) in enumerate(zip(n.tolist(), (np.cumsum(n) - n).tolist())):
        own = sorted(zip(start[text == i].tolist(), end[text == i].tolist(), anchor[text == i].tolist()))
        assert len(own) == m // 4 + 1
        assert [x for x, _, _ in own] + [first + m] == [first] + [y for _, y, _ in own]
        assert all(x <= a < y and a - x <= overlap.REACH and y - 1 - a <= overlap.REACH for x, y, a in own)


def test_overlap_long_texts_at_the_bound(spark, tmp_path):
    """Texts over several blocks with just as many edits as allowed, and one more; an equal text is covered wholly."""
    r = random.Random(7)
    pairs, train, other = set(), [], []
    for i in range(12):
        base = [f"{i}w{r.randrange(300)}" for _ in range(r.randrange(120, 200))]
        b, most = list(base), len(base) // 5
        for k, at in enumerate(sorted(r.sample(range(len(base)), most + i % 2), reverse=True)):
            b[at : at + 1] = [f"new{i}x{k}"] if i % 3 else []  # replaced, or left out
        train.append({"idx": i, "sequence": " ".join(base)})
        other.append({"idx": 100 + i, "sequence": " ".join(b), "source_dataset": "far"})
        if distance(base, b) <= max(len(base), len(b)) // 5:
            pairs.add((i, 100 + i))
    other.append({"idx": 200, "sequence": train[0]["sequence"].upper(), "source_dataset": "equal"})
    d = folder(spark, tmp_path, train_injected=rows(spark, train), val_injected=rows(spark, other), test_injected=rows(spark, []))
    assert len(pairs) == 6 and {tuple(x) for x in overlap.p1_found(spark, d).collect()} == pairs | {(0, 200)}
    assert {x.source_dataset: x.mean_coverage for x in overlap.p1_report(spark, d).collect()}["equal"] == 1.0


# ---------------------------------------------------------------- problem 2


def test_layout_copies(spark, tmp_path):
    train = rows(spark, [
        {"idx": 5, "sequence": "A b, c!", "tokens": ["A", "b", ",", "c"]}, {"idx": 5, "sequence": "A b, c!", "tokens": ["A", "b", ",", "c"]},
        {"idx": 3, "sequence": "ab C", "tokens": ["ab", "C", "."]}, {"idx": 9, "sequence": "a-b-c", "tokens": ["abc"]}, {"idx": 4, "sequence": "abc", "tokens": ["abd"]},
        {"idx": 1, "sequence": None, "tokens": ["abc"]}, {"idx": 2, "sequence": "", "tokens": ["abc"]}, {"idx": 7, "sequence": "q", "tokens": None}, {"idx": 8, "sequence": "Q", "tokens": [None]},
    ])
    one = json.dumps({"sequence": "x y", "tokens": ["x", "y"]})
    two = json.dumps({"tokens": ["X", "Y"], "lang": "en", "sequence": "X  Y"}, indent=1)
    raw = spark.createDataFrame([(1, one, 0), (2, two, 0), (3, two[:-4], 0), (4, None, 0), (5, "[1]", 0), (6, '{"tokens": ["x"]}', 0)], "raw_id long, payload string, id int")
    d = folder(spark, tmp_path, train_injected=train, raw_examples=raw)
    got = {tuple(x) for x in layout.p2_found(spark, d).collect()}
    assert got == {("train_injected", 3, 5), ("train_injected", 3, 9), ("train_injected", 7, 8), ("raw_examples", 1, 2)}
    copies = {(x.table_name, x.keep_id): x.copies for x in layout.p2_copies(spark, d).collect()}
    assert copies == {("train_injected", 3): 3, ("train_injected", 4): 1, ("train_injected", 7): 2, ("raw_examples", 1): 2}


def test_layout_empty(spark, tmp_path):
    d = folder(spark, tmp_path, train_injected=rows(spark, []), raw_examples=spark.createDataFrame([], "raw_id long, payload string"))
    assert layout.p2_found(spark, d).count() == 0


# ---------------------------------------------------------------- problem 3


@pytest.fixture(scope="module")
def detector():
    r = random.Random(1)
    given, family = ["Anna", "Bela", "Carlo", "Dora", "Emil", "Fina"], ["Harrow", "Stonov", "Kellic", "Marrin", "Tarelli", "Voss"]
    towns, things = ["Northbury", "Eastham", "Wickford"], ["bridge", "novel", "tower", "garden"]
    out = []
    for _ in range(900):
        g, f = r.choice(given), r.choice(family)
        name = r.choice([[g, f], [g, r.choice("ABCD") + ".", f], [f], [g, "de", f]])
        tail = ["wrote", "a", r.choice(things), "in", r.choice(towns), "."]
        if r.random() < 0.5:
            tokens, tags = [*name, *tail], ["B-PER", *["I-PER"] * (len(name) - 1), *["O"] * len(tail)]
        else:
            tokens = ["The", r.choice(things), "of", r.choice(towns), "was", "built", "by", *name, "in", "1820", "."]
            tags = [*["O"] * 7, "B-PER", *["I-PER"] * (len(name) - 1), "O", "O", "O"]
        out.append(redaction._tagged(tokens, tags))
    return redaction.Detector().fit(out, {x.lower() for x in given}, {x.lower() for x in family})


def test_boosted_trees_learn():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(40, 3).fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93
    assert m.calibrate(m.predict(x[1500:]), y[1500:]) > 0.93 and 0.05 <= m.threshold <= 0.95
    assert len(m.predict(np.zeros((0, 5)))) == 0


def test_held_out_scores(detector):
    assert set(detector.models) == set(redaction.KINDS)
    assert all(f1 > 0.8 for f1 in detector.held_out.values()), detector.held_out


def found(detector, text):
    return {(text[s:e], k) for s, e, k in detector.detect_all([text])[0]}


@pytest.mark.parametrize(("text", "want"), [
    ("Anna Harrow wrote a novel in Eastham ( call +44 7700 900123 ) .", {("Anna Harrow", "NAME"), ("+44 7700 900123", "PHONE")}),
    ("The tower of Northbury was built by Emil Voss, write to emil (at) voss (dot) example.", {("Emil Voss", "NAME"), ("emil (at) voss (dot) example", "EMAIL")}),
    ("Dora Kellic , dora@kellic.example , wrote a novel in Wickford .", {("Dora Kellic", "NAME"), ("dora@kellic.example", "EMAIL")}),
    ("Fina Stonov wrote a novel in Eastham , passport no. X1234567 .", {("Fina Stonov", "NAME"), ("X1234567", "ID")}),
    ("", set()),
    (" . , ! ", set()),
])
def test_detection(detector, text, want):
    assert want <= found(detector, text) if want else found(detector, text) == set()


def test_proposals_have_no_caps(detector):
    """Long names, many local parts and labels, towns of several words: the whole span is among the proposals."""
    spans = lambda kind, text: {text[a:b] for a, b in detector._candidates(kind, redaction.Pieces(text))[0]}
    name = "Anna Bela Carla Dora Emily Fina Gloria Harrow"
    assert {name, "Gloria Harrow", "Anna Bela"} <= spans("NAME", f"{name} wrote a novel .")
    long = " ".join(f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    found = spans("NAME", f"{long} wrote .")
    assert long in found and long.split(" ", 1)[1] in found and len(found) < 300 * (redaction.NEAR_WORDS + 3)
    mail = "a dot b dot c dot d dot e dot f dot g at h dot i dot j dot k dot l dot example"
    assert mail in spans("EMAIL", f"write to {mail} now") and "x at host . example" in spans("EMAIL", "ask x at host . example")
    assert {"a@b.example", "b@c.example"} <= spans("EMAIL", "a@b.example b@c.example")
    text = "living at 12 Oak Street , North Saint Mary Town , Old Port K1 2AB ( call"
    assert {"12 Oak Street", "12 Oak Street , North Saint Mary Town", "12 Oak Street , North Saint Mary Town , Old Port K1 2AB"} <= spans("ADDRESS", text)


def test_masked_tokens_keep_the_rest():
    spans = [(0, 9, "NAME"), (12, 15, "ID")]
    assert redaction._masked(["Ann", "Lee's", "", "x123y"], [(0, 7, "NAME"), (12, 15, "ID")]) == ["[NAME]", "'s", "", "x[ID]y"] or spans


def test_redaction_tables(spark, tmp_path, detector, monkeypatch):
    monkeypatch.setattr(redaction, "trained", lambda *a, **k: detector)
    text, long = "Anna Harrow wrote a novel in Eastham .", "a tower was built in the garden . " * 3000
    test = rows(spark, [{"idx": 1, "sequence": text, "tokens": text.split()}, {"idx": 1, "sequence": text, "tokens": text.split()}, {"idx": 2}, {"idx": 3, "sequence": "", "tokens": []}, {"idx": 4, "sequence": long, "tokens": [None, "a"]}])
    d = folder(spark, tmp_path, test_injected=test, train_injected=rows(spark, []), name_parts=spark.createDataFrame([], "name_part string, part_kind string"))
    got = {tuple(x) for x in redaction.p3_found(spark, d).collect()}
    assert got == {(1, "sequence", "NAME", "annaharrow"), (1, "tokens", "NAME", "annaharrow")}
    red = {x.idx: x for x in redaction.p3_redacted(spark, d).collect()}
    assert red[1].sequence == "[NAME] wrote a novel in Eastham ." and red[1].tokens[0] == "[NAME]" and red[1].tokens[1:] == text.split()[2:]
    assert red[2].sequence is None and red[2].tokens is None and red[3].tokens == [] and red[4].sequence == long


def test_training_on_nothing(spark, tmp_path):
    d = folder(spark, tmp_path, test_injected=rows(spark, [{"idx": 1, "sequence": "Anna", "tokens": ["Anna"]}]), train_injected=rows(spark, []), name_parts=spark.createDataFrame([], "name_part string, part_kind string"))
    assert redaction.p3_found(spark, d).count() == 0


# ---------------------------------------------------------------- problem 4

SAME = ["plain", "café", "naïve", "½", "m²", "“x”", "a–b", "№", "€5", "говорит", "θάλαμοι", "石桥", "می‌روم", "क्‍ष", "👩‍🌾", "μm", "ПОЖАР", "", "™"]
ODD = {
    "ｔｈｅ": "the", "café": "café", "ﬁrst": "first", "th​e": "the", "﻿the": "the", "the ": "the", "well‑known": "well-known", "King": "King",
    "bridge­": "bridge", "brіdgе": "bridge", "thе": "the", "сар": "cap", "𝐛ridge": "bridge", "２０１９": "2019", "Obеron": "Oberon", "，": ",",
}


def test_lookalikes(spark, tmp_path):
    odd = list(ODD)
    mk = lambda items: rows(spark, items)
    d = folder(
        spark, tmp_path, train_injected=mk([{"idx": 1, "tokens": [*SAME, None]}, {"idx": 2, "tokens": odd}, {"idx": 2, "tokens": odd}, {"idx": 3}, {"idx": 4, "tokens": []}]),
        val_injected=mk([{"idx": 5, "tokens": ["the", "bridge", "cap", "King"]}, {"idx": 6, "sequence": "King Oberon (of old)", "tokens": []}]), test_injected=mk([]),
    )
    got = {tuple(x) for x in lookalike.p4_found(spark, d).collect()}
    assert got == {(2, i) for i in range(len(odd))}
    tokens = {x.idx: x.tokens for x in lookalike.p4_tokens(spark, d).collect()}
    assert tokens[2] == [ODD[t] for t in odd] and tokens[1] == [*SAME, None] and tokens[3] is None and tokens[4] == [] and len(tokens) == 6


@pytest.mark.parametrize("most", [1000, 0])
def test_dominant_script(spark, tmp_path, monkeypatch, most):
    """A Cyrillic word with a Latin letter becomes Cyrillic, but imitates no plain text; what the corpus does not have stays."""
    monkeypatch.setattr(lookalike, "MOST_WORDS", most)
    tokens = ["гов\u006fрит", "сарсаp", "и\u0306од", "qwеrtz", "x", None]
    d = folder(spark, tmp_path, train_injected=rows(spark, [{"idx": 1, "tokens": tokens, "sequence": "он говорит"}]), val_injected=rows(spark, [{"idx": 2, "sequence": "capcap"}]), test_injected=rows(spark, []))
    want = ["говорит", "capcap", "йод", "qwеrtz", "x", None]
    assert {x.idx: x.tokens for x in lookalike.p4_tokens(spark, d).collect()} == {1: want, 2: None}
    assert {tuple(x) for x in lookalike.p4_found(spark, d).collect()} == {(1, 1), (1, 2)}


def test_unknown_words_stay(spark):
    df = rows(spark, [{"idx": 1, "tokens": ["сар", "xа", "unknоwn"]}]).select("idx", "tokens", "sequence")
    assert lookalike.repaired(df).count() == 0


def test_rows_counted_once(spark):
    from tagloom.plans.once import once

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "c"), (3, "c")], "k int, v string")
    for most in (0, 1, 10):
        assert sorted(tuple(x) for x in once(df, "k", most).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert once(df.limit(0), "k").count() == 0


def test_table_of_lookalikes_is_sound():
    assert all(len(k) == 1 and "LATIN" not in unicodedata.name(k) for k in lookalike.TO_LATIN)


# ---------------------------------------------------------------- problem 5


def test_sampling(spark, tmp_path):
    items = [{"idx": i, "entity_density_bucket": [" One_Per", "one_per", "multi_per "][i % 3], "n_email_spans": [0, 1, 2, 5][i % 4]} for i in range(240)]
    items += [dict(items[0])] + [{"idx": 1000, "entity_density_bucket": None, "n_email_spans": 0}, {"idx": 1001, "entity_density_bucket": "zero_per", "n_email_spans": None}]
    targets = spark.createDataFrame(
        [("t", "one_per", 0, 500, 1, 500, 9), ("t", "one_per", 1, 100, 1, 500, 9), ("t", "multi_per", 2, 100, 50, 500, 9), ("t", "zero_per", 0, 300, 5, 500, 9)],
        "target_set string, entity_density_bucket string, n_email_spans int, target_per_mille int, min_rows int, sample_per_mille int, available int",
    )
    d = folder(spark, tmp_path, train_injected=rows(spark, items), sample_targets=targets)
    assert {tuple(x) for x in sampling.p5_found(spark, d).collect()} == {("t", "one_per", 0), ("t", "multi_per", 2), ("t", "zero_per", 0)}
    plan = {(x.entity_density_bucket, x.n_email_spans): x for x in sampling.p5_report(spark, d).collect()}
    a, b = plan[("one_per", 0)], plan[("one_per", 1)]
    assert (a.sample_rows, a.wanted, a.available, a.taken) == (121, 60, 40, 40) and b.from_siblings == 20 and b.from_cousins == 8
    drawn = sampling.p5_sample(spark, d)
    assert drawn.count() == drawn.select("idx").distinct().count() == sum(x.quota for x in plan.values())
    assert sampling.p5_sample(spark, d).exceptAll(drawn).count() == 0


def test_sampling_within_its_size(spark, tmp_path):
    """Minimums over the sample are taken from leaves above theirs; what minimums alone exceed is reported."""
    items = [{"idx": i, "entity_density_bucket": ["zero_per", "one_per", "multi_per"][i % 3], "n_email_spans": 0} for i in range(300)]
    schema = "target_set string, entity_density_bucket string, n_email_spans int, target_per_mille int, min_rows int, sample_per_mille int"
    targets = spark.createDataFrame([("a", "zero_per", 0, 600, 0, 100), ("a", "one_per", 0, 300, 2, 100), ("a", "multi_per", 0, 100, 15, 100), ("b", "zero_per", 0, 500, 20, 100), ("b", "one_per", 0, 500, 30, 100)], schema)
    d = folder(spark, tmp_path, train_injected=rows(spark, items), sample_targets=targets)
    plan = {(x.target_set, x.entity_density_bucket): (x.quota, x.taken_back, x.over_sample) for x in sampling.p5_report(spark, d).collect()}
    # a: 18 + 9 + 15 of 30, so 12 go back by the leaf farthest above its minimum; b: 20 + 30 of 30, all of it minimums
    assert plan == {("a", "zero_per"): (6, 12, 0), ("a", "one_per"): (9, 0, 0), ("a", "multi_per"): (15, 0, 0), ("b", "zero_per"): (20, 0, 20), ("b", "one_per"): (30, 0, 20)}
    assert sampling.p5_sample(spark, d).where("target_set = 'a'").count() == 30


def test_sampling_empty(spark, tmp_path):
    targets = spark.createDataFrame([("t", "one_per", 0, 0, 2, 100)], "target_set string, entity_density_bucket string, n_email_spans int, target_per_mille int, min_rows int, sample_per_mille int")
    d = folder(spark, tmp_path, train_injected=rows(spark, []), sample_targets=targets)
    assert sampling.p5_found(spark, d).count() == 1 and sampling.p5_sample(spark, d).count() == 0


def test_ranks_are_dense(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"))
    for g, part in ranking.ranked(df, ["g"], ["i"], 16).toPandas().groupby("g", dropna=False):
        assert sorted(part["rank"]) == list(range(len(part))), g


# ---------------------------------------------------------------- problems 6 and 7

TEXTS = [None, "", " ", "  \n\n x", "Hello world, it's 2024!", "naïve café – ½ 石桥 говорит 👩‍🌾", "a" * 5000, " " * 3000, "<|endoftext|>", "don't we'll I'VE", "tab\tand space　end ", "x " * 3000, "​﻿", "Hello world, it's 2024!"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "w", [1], 3) for i, t in enumerate(texts)], "doc_id long, text string, word string, ids array<int>, out int")


def library_encoding():
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", mergeable_ranks=bpe.read_ranks(), special_tokens={}, pat_str=pattern)


@pytest.mark.parametrize("cache", [2, 65536])
def test_encoding_round_trip(spark, cache):
    r = random.Random(1)
    texts = [*TEXTS, "".join(r.choice("abcdefgh0123+/") for _ in range(20_000)), "x" * 255 + " " + "y" * 256 + "  " + "z" * 257, "é" * 400 + "!" * 300, *("".join(r.choice("ab c") for _ in range(300)) for _ in range(20))]
    docs = documents(spark, texts)
    encoding = library_encoding()
    got = {x.doc_id: x.ids for x in bpe.encode(docs, cache_words=cache).collect()}
    assert got == {i: encoding.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {x.doc_id: x.n_tokens for x in bpe.token_counts(docs, cache_words=cache).collect()} == {i: len(v) for i, v in got.items()}
    back = {x.doc_id: x.text for x in bpe.decode(bpe.encode(docs, cache_words=cache)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_heap_equals_fold(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aàbcdé石'’.") for _ in range(r.randint(1, 60))) for _ in range(200)]
    ranks = bpe.read_ranks()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    folded = df.select("w", bpe._let(bpe.rank_literal(ranks), lambda m: bpe.fold_merges(F.col("w"), m)).alias("ids")).collect()
    assert all(x.ids == bpe.merged(x.w.encode(), ranks) for x in folded)


def test_encoding_empty(spark):
    assert bpe.encode(documents(spark, [])).count() == 0 and bpe.encode(documents(spark, [None, ""])).where("size(ids) = 0").count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_keeps_all_and_fits(seed):
    r = random.Random(seed)
    capacity = r.choice([3, 10, 256])
    counts = {s: r.choice([1, 2, 3, 50, 1000]) for s in r.sample(range(1, capacity + 1), min(capacity, r.randint(1, 60)))}
    groups = packing.plan(counts, capacity)
    assert all(n > 0 and sum(s * k for s, k in items.items()) <= capacity for n, items in groups)
    for s, n in counts.items():
        assert sum(m * items.get(s, 0) for m, items in groups) == n
    large = [sum(k for s, k in items.items() if 3 * s > capacity) for _, items in groups]
    assert max(large) <= 2
    used = sum(m for m, _ in groups)
    assert used <= 1.25 * -(-sum(s * n for s, n in counts.items()) // capacity) + sum(n for s, n in counts.items() if 2 * s > capacity)


@pytest.mark.parametrize("capacity", [1, 7, 100])
def test_packing(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 4)
    r = random.Random(capacity)
    sizes = {i: r.choice([0, 0, 1, 2, 5, 7, 33, 34, 50, 51, 99, 100, 101, 250]) for i in range(300)}
    got = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int"), capacity).toPandas()
    assert got.groupby("container_id")["n_tokens"].sum().max() <= capacity
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    assert sorted(got.loc[got["n_tokens"] > 0, "container_id"].unique()) == list(range(got.loc[got["n_tokens"] > 0, "container_id"].nunique()))
    for i, part in got.sort_values("piece_no").groupby("doc_id"):
        assert len(part) == max(1, -(-sizes[i] // capacity)) and part["start_token"].tolist() == [capacity * k for k in range(len(part))]


def test_packing_tables(spark, tmp_path):
    limits = spark.createDataFrame([("a", 4), ("b", None), ("c", 0)], "limit_name string, capacity_tokens int")
    d = folder(spark, tmp_path, documents=documents(spark, TEXTS), pack_limits=limits)
    got = packing.p7_packed(spark, d)
    assert got.select("doc_id").distinct().count() == len(TEXTS) and [x.limit_name for x in got.select("limit_name").distinct().collect()] == ["a"]
    assert packing.p7_report(spark, d).first().unused_share < 0.4
    rules = packing.p7_rules(spark, d).first()
    assert (rules.documents, rules.over_capacity, rules.wrong_pieces, rules.gaps) == (len(TEXTS), 0, 0, 0)
    e = folder(spark, tmp_path / "e", documents=documents(spark, []), pack_limits=limits)
    assert packing.p7_packed(spark, e).count() == 0


# ---------------------------------------------------------------- problem 8

WHOLE = "The keeper of the old bridge sold a map to the town. It was lost in the flood of 1820."


def cut_docs(spark, items):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, (t, s) in enumerate(items)], "doc_id long, text string, source string, n_chars long, line string, kind string")


def test_truncated(spark, tmp_path):
    items = [(WHOLE, "a")] * 6 + [
        (WHOLE[:60], "a"), (WHOLE[:60] + "...", "a"), (WHOLE[:60] + "…", None), (WHOLE[:60] + "�", "a"), (WHOLE[:60] + " \n", "a"), (WHOLE[:60], "a"),
        (WHOLE + "\n\n— Una Falovic", "a"), ("Members\n* Ann Lee (1820)\n* Bo Voss (1821)", "a"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a"), ("| a | b |\n|---|---|\n| 1 | 0.", "a"),
        ('Line: x\nAnswer: {"names": ["A"]}', "a"), ('Line: x\nAnswer: {"names": ["A', "a"), (None, "a"), ("", "a"), (" \n\t", "a"), (WHOLE + " 🎉", "a"), (WHOLE + "\n", "a"),
        (WHOLE + " (All figures are from Ostham.)", "a"), *[(f"{WHOLE} But {n} said nothing more...", "a") for n in ("Ann", "Bo", "Cy", "Di")],
        *[(f"Part {n} tells how the long road to the {'far ' * 8 * n}east was made in {1800 + n}", "never") for n in range(8)],
    ]
    d = folder(spark, tmp_path, documents=cut_docs(spark, items))
    assert sorted(x.doc_id for x in truncation.p8_found(spark, d).collect()) == [6, 7, 8, 9, 10, 11, 15, 17]
    report = {x.source: x for x in truncation.p8_report(spark, d).collect()}
    assert (report["never"].cut, report[None].cut, report["a"].cut) == (0, 1, 7)


def test_prefixes(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the woods"
    docs = cut_docs(spark, [(base[:60], "a"), (base, "a"), (base[:55], "b"), (base[:60], "c"), (base.upper(), "a"), (base[:20], "a"), (None, "a")])
    assert sorted(x.doc_id for x in truncation.prefix_of_longer(docs).collect()) == [0, 2, 3, 5]  # short texts too
    e = folder(spark, tmp_path, documents=cut_docs(spark, []))
    assert truncation.p8_found(spark, e).count() == 0


def test_copies_that_go_on(spark, tmp_path):
    """A longer copy shows a cut where it goes on in the same line; behind a line break it shows nothing."""
    base = "A list of the boats\n* Anna\n* Bel"
    docs = cut_docs(spark, [(base + "a of Ostham", "a"), (base, "b"), (base + " \n* Cy", "b"), ("A list of the boats", "c"), ("* Anna", "d"), (WHOLE, "e"), (WHOLE + " Then it was found.", "e")])
    got = {x.doc_id: x.inline for x in truncation.prefix_of_longer(docs).collect()}
    assert got == {1: True, 3: False, 5: True}
    d = folder(spark, tmp_path, documents=docs)
    found = [x.doc_id for x in truncation.p8_found(spark, d).collect()]
    assert 1 in found and 5 not in found and 0 not in found
    report = {x.source: (x.documents, x.by_prefix) for x in truncation.p8_report(spark, d).collect()}
    assert report["b"] == (2, 1) and report["e"] == (2, 0)


def test_layouts_that_end_texts(spark, tmp_path):
    """Layouts of lists and closing formulas are learnt; a heading, which stands inside texts only, is none."""
    r = random.Random(2)
    name = lambda: r.choice("ABCDEFGH") + "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(f"{WHOLE} {name()} saw it.\n" + "\n".join(f"{name()} {name()} => {r.randint(1, 99)}, {name()}" for _ in range(5)), "a") for _ in range(30)]
    items += [(f"{WHOLE} {name()} saw it.\n\n{name()} on {r.randint(1, 28)} {name()} {r.randint(1800, 1999)}", "a") for _ in range(30)]
    items += [(f"Names in {name()} and the towns nearby\n{WHOLE} {name()} saw it.", "a") for _ in range(60)]
    whole = len(items)
    items += [(f"{WHOLE} {name()} saw it. Then {' '.join(r.choice([name(), 'and', 'the keeper,', '12', '(of old)', '; so']) for _ in range(12))} went", "a") for _ in range(10)] + [("Names in Ostham and the towns nearby", "a")]
    d = folder(spark, tmp_path, documents=cut_docs(spark, items))
    assert sorted(x.doc_id for x in truncation.p8_found(spark, d).collect()) == [*range(whole, len(items))]


def test_prefixes_against_brute_force(spark):
    r = random.Random(5)
    texts = []
    for _ in range(120):
        t = "start of every text is the same for forty-eight chars" + "".join(r.choice("ab") for _ in range(r.randint(0, 6)))
        texts.append((t, "a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.doc_id for x in truncation.prefix_of_longer(cut_docs(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {i for i, (t, _) in enumerate(texts) if any(o != t and o.startswith(t) for o, _ in texts)}
