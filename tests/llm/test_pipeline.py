"""The pipeline's stages against brute force, and the registration of its queries."""

import pytest

pytest.importorskip("postlytics.llm")

import corpus_pipeline as C  # noqa: E402
import __spark_entry__ as E  # noqa: E402
from postlytics.llm.common import store  # noqa: E402
from tests.llm.test_operators import slow_classes, slow_repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = {"start": docs}
    for name, stage in C.STAGES:
        docs = found[name] = store(stage(spark, docs, SF), "stage")
    rows = {k: sorted(v.collect(), key=lambda r: r.doc_id) for k, v in found.items()}
    good = {r.doc_id for r in rows["quality classifier"]}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in good for d in clean) >= 0.9 * len(clean)
    white = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
    first = {}
    for r in rows["quality classifier"]:
        first.setdefault(r.text.translate(white), []).append((-len(r.text), r.doc_id))
    assert [r.doc_id for r in rows["exact dedup"]] == sorted(min(x)[1] for x in first.values())
    classes = slow_classes([r.text for r in rows["exact dedup"]])
    assert [r.doc_id for r in rows["near-duplicates"]] == [r.doc_id for i, r in enumerate(rows["exact dedup"]) if classes[i] == i]
    want = [x[0].decode("utf-8", "ignore") for x in slow_repeats([r.text for r in rows["near-duplicates"]], 200)]
    assert [r.text for r in rows["suffix-array dedup"]] == want
    assert {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["suffix-array dedup"]}
    for name in [n for n, _ in C.STAGES[:-1]]:
        assert found[name].columns == C.COLUMNS


def test_cuts_take_split_characters_only(spark):
    hole = "".join(f"word{i} " for i in range(60))  # the characters around it share a byte in both texts
    rows = [(1, f"one \ufffd \u00e9{hole}\u00e9 \ufffdend"), (2, f"two \ufffd\u0129{hole}\u00e8 \ufffd\ufffd"), (3, "\ufffd alone"), (4, None), (5, hole)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in C.without_repeats(spark, docs, SF).collect()}
    want = {1: "one \ufffd  \ufffdend", 2: "two \ufffd \ufffd\ufffd", 3: "\ufffd alone", 4: None, 5: ""}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == (None if t is None else len(t)) for t, n in got.values())


def test_run_and_registration(spark):
    names = set(E.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    out = C.run(spark, SF)
    assert out.count() > 0 and {"sequence_id", "offset", "ids"} <= set(out.columns)
