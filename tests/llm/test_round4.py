"""Loops whose plans stay small, however many passes they take."""

from foliant.llm import jaccard_join
from foliant.llm.components import roots


def estimate(rows) -> int:
    """Digits, in bits, of Spark's estimate of the rows' size."""
    return rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_of_components_do_not_grow_with_passes(spark, tmp_path):
    path = [(k * 37 % 65, (k + 1) * 37 % 65) for k in range(64)]
    found = roots(spark.createDataFrame(path, "a long, b long"), str(tmp_path / "roots"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, found.first().root) for k in range(65)}
    assert estimate(found) < 200


def test_estimates_of_near_copies_do_not_grow_with_rounds(spark, monkeypatch):
    """Texts that have a passage in common but are no copies meet a few at a time, in many rounds."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    common = " ".join(f"common{k}" for k in range(9))
    texts = [f"{common} " + " ".join(f"own{i}x{k}" for k in range(2)) for i in range(6)] + [f"{common} tail{i // 2} end" for i in range(4)]
    held: list = []
    whole = jaccard_join._components
    monkeypatch.setattr(jaccard_join, "_components", lambda *a: held.append(whole(*a)) or held[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for a in want:
            for b, s in enumerate(sets):
                if 4 * len(s & sets[a]) >= 3 * len(s | sets[a]):
                    want[b] = want[a] = min(want[a], want[b])
    assert got == dict(enumerate(want))
    assert estimate(held[0]) < 200
