"""Repeated texts and larger tables change no verdict on a cut text."""

from tagloom.llm import truncation
from tests.llm.test_operators import WHOLE, cut_docs, folder


def found(spark, tmp_path, items):
    d = folder(spark, tmp_path, documents=cut_docs(spark, items))
    return sorted(r.doc_id for r in truncation.p8_found(spark, d).collect())


def test_repeated_cut_texts(spark, tmp_path):
    rows = [(f"{WHOLE} {w} was there.", "a") for w in ("Ann", "Bo", "Cy", "Di", "Ed")]
    # one text under many ids makes no usual ending, no source without marks and no label that closes texts
    rows += [("The miller of the new mill bought a horse from the...", "a")] * 8
    rows += [("A short line without its far end", "b")] * 8 + [("Another line, much longer than the first one, that is also without its far end", "b")]
    rows += [(f"Report {n}\nQuestion: who is {n}\nAnswer: it is {n}.", "a") for n in ("Ann", "Bo")] + [(f"{WHOLE}\nQuestion: who was it", "a")] * 5
    assert found(spark, tmp_path, rows) == [*range(5, 22), *range(24, 29)]


def test_fragments_in_a_source_without_marks(spark, tmp_path):
    never = [(f"Part {n} tells how the long road to the {'far ' * 8 * n}harbour of {w}", "never") for n, w in enumerate(("Ostham", "Maralworth", "Ostham"))]
    never += [(f"The harbour of Ostham and the road to Maralworth {'and on ' * n}were made in {1800 + n}", "never") for n in range(9)]
    # a fragment under two ids, one that ends two texts, a capitalised one, and whole words
    cut = [("Twelve men went to Maralworth along the harb", "never")] * 2
    cut += [("Thirteen men went to Ostham along the roa", "never"), ("Fourteen men came back along the roa", "never"), ("Fifteen men went along the road to Maralwo", "never")]
    assert found(spark, tmp_path, never + cut + [("Sixteen men went along the road", "never")] + [(WHOLE, "a")]) == [*range(12, 17)]
    # no count decides: at ten times the size the same words and fragments come out alike
    many = [(f"{i} {t}", s) for i in range(10) for t, s in never + cut]
    assert found(spark, tmp_path / "many", many) == [i * 17 + k for i in range(10) for k in range(12, 17)]
