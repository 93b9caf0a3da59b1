import random

import corpus_pipeline
from lodestone.llm import ngram_join


def test_stages_keep_the_columns_and_work_on_what_came_before(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    toxic = set(range(0, 200, 4))
    rows = [(i, t + (" wretchling vilefoot" if i in toxic else "")) for i, t in enumerate(texts)]
    copied = next(i for i in range(200) if i not in toxic)
    line = " ".join(words[:12])
    rows += [(1000, rows[copied][1].replace(words[3], "other")), (1001, "own words here\n" + line), (1002, line + "\nmore words there"), (1003, None), (1004, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            at = spark.read.parquet(f"{tmp_path}/{name}")
            kept[name] = {r.doc_id: r.text for r in at.collect()}
        else:
            pieces = out.collect()
    clean = set(range(200)) - toxic
    assert len(clean & kept["toxicity"].keys()) >= 0.97 * len(clean) and len(toxic & kept["toxicity"].keys()) <= 0.1 * len(toxic)
    assert kept["line_dedup"].keys() == kept["toxicity"].keys()
    assert kept["line_dedup"][1002] == "more words there"
    assert {r.doc_id for r in pieces} == kept["ngram_join"].keys()
    groups = {r.doc_id: r.component_id for r in ngram_join.near_groups(spark.read.parquet(f"{tmp_path}/line_dedup")).collect()}
    sizes = {r.doc_id: r.n_shingles for r in ngram_join.near_groups(spark.read.parquet(f"{tmp_path}/line_dedup")).collect()}
    assert kept["ngram_join"].keys() == {i for i, c in groups.items() if i == c or not sizes[i]}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in run.collect()) == sum(r.length for r in pieces)


def test_line_dedup_stage_takes_short_lines(spark):
    docs = spark.createDataFrame([(1, "Les.\nown words of one"), (2, "Les.\nothers stand here"), (3, "17"), (4, "18")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.recurring_lines(spark, docs, "").collect()}
    assert got == {1: "Les.\nown words of one", 2: "others stand here", 3: "17", 4: "18"}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, mark string, key int, id string, drop int, n_dropped string, score double, component_id string, pos int"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "m", 1, "x", 2, "n", 0.5, "c", 3) for i, t in rows], CLASHING)


def stages(spark, docs, folder):
    """(name, docs after the stage) of all stages, each written and read again."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        yield name, docs


def test_near_copies_repeated_rows_null_ids_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=50)) + (" vilefoot wretchling" if i % 5 == 0 else "")) for i in range(150)]
    text = [rng.choice(words) for _ in range(84)]
    lines = lambda n, w: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    changed = [*text[:40], "other", *text[41:]]
    # The same words in other lines: line dedup sees nothing, the join a near copy; then one row three times, nulls, and next to nothing.
    rows += [(500, lines(12, text)), (501, lines(7, changed)), (600, "a row of its own that comes again and again"), (600, "a row of its own that comes again and again"), (600, "a row of its own that comes again and again")]
    rows += [(None, "a text without an id stands here for once"), (None, None), (700, None), (701, ""), (702, " \n\t"), (703, "word"), (704, " ".join([rows[1][1]] * 600))]
    wide(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {name: df.collect() for name, df in stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))}
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    clean = [i for i in range(150) if i % 5]
    assert len(set(clean) & set(ids["toxicity"])) >= 0.97 * len(clean) and sum(i in ids["toxicity"] for i in range(0, 150, 5)) <= 3
    assert {500, 501, 600, 700, 701, 702, 703, 704, None} <= set(ids["toxicity"]) and ids["toxicity"].count(600) == 3
    assert sorted(map(str, ids["line_dedup"])) == sorted(map(str, ids["toxicity"]))
    assert 500 in ids["ngram_join"] and 501 not in ids["ngram_join"] and ids["ngram_join"].count(600) == 1
    assert {700, 701, 702, 703, None} <= set(ids["ngram_join"])
    assert 1 in ids["ngram_join"] and 704 not in ids["ngram_join"]  # it says nothing but row 1 again and again
    assert all(r.mark == "m" and r.key == 1 and r.score == 0.5 and r.n_dropped == "n" for r in kept["ngram_join"])
    assert set(ids["packing"]) == set(ids["ngram_join"])
    lengths = {}
    for r in kept["packing"]:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in lengths.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def test_nothing_goes_through_all_stages(spark, tmp_path):
    wide(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, df in stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)):
        assert df.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
