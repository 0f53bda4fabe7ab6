"""The whole pipeline on a small corpus against a plain version of its stages."""

import os
import random

import pytest

from tests.llm.test_text_operators import classes, leaks, plain_spans

pipeline = pytest.importorskip("corpus_pipeline")


def corpus(rng):
    word = lambda: "".join(rng.choices("bcdfghlmn", k=rng.randrange(3, 8)))
    insults = ["grumbok", "zwackel", "plonkard"]
    items = [(j, " ".join(word() for _ in range(rng.randrange(15, 50)))) for j in range(10)]
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            words[3], words[9] = rng.choice(insults), rng.choice(insults)
        if i % 7 == 1:
            words[5:5] = rng.choice(items)[1].split()
        if i % 11 == 2:
            words[4] = f"token={rng.getrandbits(160):040x}"
        rows.append((i, " ".join(words), rng.choice("xyz")))
        labels.append((i, 1, int(toxic)))
        if i % 9 == 3:
            words[0] = word()
            rows.append((1000 + i, " ".join(words), rng.choice("xyz")))
    rows += [(2000, None, "x"), (2001, " ", None), (2002, "alone", "y"), (2002, "alone", "y")]
    return rows, items, labels


def test_against_plain_stages(spark, tmp_path):
    rows, items, labels = corpus(random.Random(12))
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    insults = ("grumbok", "zwackel", "plonkard")
    kept = [r for r in rows if not any(w in (r[1] or "") for w in insults)]
    texts = {i: t for i, t, _ in kept}
    group = classes(list(texts.items()))
    texts = {i: t for i, t in texts.items() if group[i][1] == i}
    bad = {i for i, _ in leaks(list(texts.items()), items)}
    texts = {i: t for i, t in texts.items() if i not in bad}
    assert bad and len(texts) < len({i for i, *_ in kept})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
    found = {r.doc_id: r for r in docs.collect()}
    assert docs.count() == len(found) and set(found) == set(texts)
    for i, t in texts.items():
        if t is None:
            assert found[i].text is None
            continue
        clean, at = "", 0
        for a, _, b in plain_spans(t):
            if a >= at:
                clean += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert found[i].text == clean + t[at:] and found[i].n_chars == len(found[i].text)
    mix = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    size = {i: len((r.text or "").split()) for i, r in found.items()}
    assert {i: r["size"] for i, r in mix.items()} == size and all(0 <= r.taken <= 2 * r["size"] for r in mix.values())
    assert abs(sum(r.taken for r in mix.values()) - 1.5 * sum(size.values())) <= 5


def test_run_is_the_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "mixing"] and pipeline.ORACLE_SQL is None
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    out = pipeline.run(spark, data)
    assert {"doc_id", "size", "taken"} <= set(out.columns) and out.count() > 100


def test_rows_are_judged_one_by_one(spark, tmp_path):
    """Repeated and null ids, map columns and clashing names: no text is lost, no second copy stays."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bcdfghlmn", k=5))
    a, b, c, item = (" ".join(word() for _ in range(40)) for _ in range(4))
    rows = [(1, a), (9, a), (9, b), (None, c), (None, c), (None, a), (5, c), (7, None), (7, None), (None, " "), (8, item), (None, item), (3, b.upper()), (6, "long " * 60_000), (6, "long " * 60_000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, cls map<string,int>, row int, key string"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), {"x": 1}, 2, "k") for i, t in rows], kind)
    kept = pipeline.near_duplicates(spark, frame, "")
    assert kept.schema == frame.schema
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:300]) for r in kept.collect())
    assert got == sorted([(1, a), (3, b.upper()), (5, c), (7, ""), (7, ""), (-1, " "), (8, item), (6, ("long " * 60_000)[:300])])
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").limit(0).write.parquet(f"{sf}/labels.parquet")
    assert pipeline.decontamination(spark, frame, sf).count() == len(rows) - 2
    assert pipeline.toxicity(spark, frame, sf).count() == len(rows)
    assert pipeline.secret_redaction(spark, frame, sf).schema == frame.schema
    mixed = pipeline.source_mix(spark, frame, sf)
    assert mixed.count() == len(rows) and {r.taken for r in mixed.where("size = 0").collect()} == {0}
    frame.limit(0).write.parquet(f"{sf}/documents.parquet")
    assert pipeline.run(spark, sf).count() == 0
