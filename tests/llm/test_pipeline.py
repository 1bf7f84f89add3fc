import random

import corpus_pipeline as C
from pyspark.sql import functions as F

STOP = "the of and to in is that it was for on with as by at".split()


def text(rng, n):
    return " ".join(rng.choice(STOP) if rng.random() < 0.3 else rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdlmnrst") + str(rng.randrange(90)) for _ in range(n)) + "."


def write(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_remove_what_they_should(spark, tmp_path):
    rng = random.Random(2)
    item, passage = text(rng, 40), text(rng, 60)
    clean = {i: text(rng, 150) for i in range(30)}
    near = clean[3].split()
    near[70:71] = ["changedword"]
    docs = {**clean, 100: "### *** $$$ " * 30, 101: None, 102: "too short", 103: text(rng, 50) + "\n" + item + "\n" + text(rng, 50), 104: clean[5], 105: " ".join(near) + "\n" + clean[29], 106: text(rng, 90) + "\n" + passage, 107: text(rng, 90) + "\n" + passage}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    d = write(spark, tmp_path, rows, [(1, item)])
    frame, kept = C.table(spark, d, "documents"), {}
    columns = frame.columns
    for name, stage in C.STAGES:
        frame = C.durable(stage(spark, frame, d))
        kept[name] = {r.doc_id for r in frame.select("doc_id").collect()}
        if name != "packing":
            assert frame.columns == columns
        if name == "line_dedup":
            texts = {r.doc_id: r for r in frame.collect()}
            middle = " ".join(passage.split()[15:45])
            assert middle in texts[106].text and middle not in texts[107].text
            assert texts[107].n_chars == len(texts[107].text)
            assert all(texts[i].text == t for i, t in clean.items())
    assert set(docs) - kept["quality_rules"] == {100, 101, 102}
    assert kept["quality_rules"] - kept["line_dedup"] == {104}
    assert kept["near_duplicates"] - kept["decontamination"] == {103}
    assert set(clean) <= kept["decontamination"] == kept["packing"]
    whole = C.run(spark, d)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, frame.drop("sequence_id", "offset").collect()))


def test_near_duplicates_keep_the_smallest_id(spark, tmp_path):
    rng = random.Random(4)
    base = text(rng, 200).split()
    rows = []
    for i in range(6):
        w = list(base)
        w[10 + 30 * i] = f"edit{i}"
        rows.append((10 - i, " ".join(w), "en", "s", 1))
    rows.append((50, text(rng, 200), "en", "s", 1))
    d = write(spark, tmp_path, rows, [])
    out = C.near_duplicates(spark, C.table(spark, d, "documents"), d)
    assert sorted(r.doc_id for r in out.collect()) == [5, 50]


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    d = write(spark, tmp_path / "a", [], [])
    assert C.run(spark, d).count() == 0
    t = text(random.Random(1), 80)
    d = write(spark, tmp_path / "b", [(1, t, "en", "s", 1)] * 2 + [(None, t, None, None, None)], [])
    out = C.run(spark, d)
    assert out.groupBy("doc_id").agg(F.sum("length")).count() == 2


def test_very_long_texts_ties_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    long = "\n".join(text(rng, 300) for _ in range(400))
    docs = [(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, text(rng, 90), "en", "s", 1)]
    d = write(spark, tmp_path, docs, [(1, text(rng, 30))])
    frame = C.table(spark, d, "documents").withColumns({"n_lines": F.lit("mine"), "n_removed": F.lit(7), "matches": F.lit("m"), "quality_verdict": F.lit(1), "component_id": F.lit(2)})
    for name, stage in C.STAGES[:4]:
        frame = C.durable(stage(spark, frame, d))
        assert {(r.n_lines, r.n_removed, r.matches, r.quality_verdict, r.component_id) for r in frame.collect()} == {("mine", 7, "m", 1, 2)}, name
    assert {r.doc_id: r.text for r in frame.collect()} == {1: long, 3: docs[2][1]}  # of equal texts the smallest id stays
    pieces = C.packing(spark, frame, d).where("doc_id = 1")
    assert pieces.agg(F.sum("length")).first()[0] == pieces.first().doc_tokens > 100_000
