import random

import pyarrow as pa

import corpus_pipeline as C
from treelift.llm.packing import VOCABULARY


def tables(spark, folder, n=160):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulmnst") for _ in range(rnd.randint(2, 7)))
    text = lambda k: "\n".join(" ".join(word() for _ in range(12)) for _ in range(k))
    docs, labels = {}, []
    for k in range(n):
        docs[k] = text(rnd.randint(2, 6))
        if k % 5 == 0:
            docs[k] = " ".join(w if rnd.random() > 0.2 else rnd.choice(["vilest", "rotten", "filthy"]) for w in docs[k].split(" "))
        labels.append((k, int(k % 5 == 0)))
    passage = text(5)
    item = " ".join(word() for _ in range(14))
    planted = {
        "toxic": [n], "near": [n + 2], "leak": [n + 3], "cut": [n + 5], "clean": [n + 1, n + 4, n + 6, n + 7, n + 8],
    }
    docs[n] = text(2) + " vilest rotten filthy vilest"
    base = [word() for _ in range(300)]
    docs[n + 1] = " ".join(base)
    docs[n + 2] = " ".join([*base[:150], "other", *base[151:]])
    docs[n + 3] = text(1) + "\n" + item.upper() + "\n" + text(1)
    docs[n + 4] = text(2) + "\n" + passage
    docs[n + 5] = text(2) + "\n" + passage
    docs[n + 6], docs[n + 7], docs[n + 8] = text(3), text(1), None
    rows = [(k, t, "en", "s0", len(t or "")) for k, t in docs.items()]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int", "labels")
    write([(1, item)], "item_id long, text string", "benchmark")
    return docs, planted, passage


def test_planted_cases(spark, tmp_path):
    docs, planted, passage = tables(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in C.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
        kept[name] = {r.doc_id: r for r in frame.collect()}
        frame = spark.createDataFrame(list(kept[name].values()), frame.schema)
    assert planted["toxic"][0] not in kept["toxicity"]
    assert all(k in kept["toxicity"] for k in (*planted["clean"], *planted["near"], *planted["leak"], *planted["cut"]))
    assert kept["line_dedup"][planted["cut"][0]].text == docs[planted["cut"][0]][: -len(passage) - 1]
    assert kept["line_dedup"][planted["cut"][0]].n_chars == len(docs[planted["cut"][0]]) - len(passage) - 1
    assert planted["near"][0] not in kept["near_dedup"]
    assert planted["leak"][0] in kept["near_dedup"] and planted["leak"][0] not in kept["decontamination"]
    assert all(k in kept["decontamination"] for k in planted["clean"])
    rows = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept["decontamination"])
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert VOCABULARY.endswith(".json")


def test_stages_pass_texts_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for name in ("drop_toxic", "drop_repeated_lines", "drop_near_duplicates", "drop_contaminated", "pack_documents"):
            monkeypatch.setattr(C, name, lambda docs, *more: docs.mapInArrow(sizes, "n long"))
        monkeypatch.setattr(C, "table", lambda *at: None)
        for _, stage in C.STAGES:
            spark.conf.set(key, 10_000)
            assert max(r.n for r in stage(spark, spark.range(0, 5000, 1, 1), "").collect()) <= 1024
        spark.conf.set(key, 100)
        C.packing(spark, spark.range(1), "")
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
