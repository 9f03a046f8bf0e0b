import re

import corpus_pipeline
from test_operators_llm import components_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns and out.dtypes == docs.dtypes
        docs = out.checkpoint()
        kept[name] = {r.doc_id: r for r in docs.collect()}
    good = kept["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(i in good for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    groups = components_of({i: r.text for i, r in good.items()}, 5)
    assert set(kept["near_dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    spans = kept["span_dedup"]
    assert set(spans) == set(kept["near_dedup"]) and all(r.n_chars == len(r.text) for r in spans.values())
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = kept["decontaminate"]
    assert not any(x in r.text for r in clean.values() for x in items)
    flat = lambda t: re.sub(r"\s+", " ", t)
    gone = [spans[i].text for i in set(spans) - set(clean)]
    assert all(any(set(flat(x).split()[:12]) & set(flat(t).split()) for x in items) for t in gone)
    want = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("doc_id").agg({"length": "sum"}).collect())
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(got.groupBy("doc_id").agg({"length": "sum"}).collect()) == want and {r.doc_id for r in want} == set(clean)


def test_stages_tell_rows_apart(spark, tmp_path):
    near = " ".join(f"n{i}" for i in range(60))
    leak = " ".join(f"b{i}" for i in range(30))
    own = {k: " ".join(f"{k}{i}" for i in range(40)) for k in ("p", "q", "r", "s", "t")}
    rows = [
        (1, near), (2, near + " more"), (2, own["p"]),  # a unique text whose id a copy shares
        (3, own["q"]), (3, own["q"]), (3, own["q"]),  # equal rows
        (None, own["r"]), (None, own["r"]), (None, own["s"]), (None, near),
        (None, f"{own['t']} {leak} here"), (4, None), (4, None), (None, None), (5, ""), (5, ""),
    ]
    docs = spark.createDataFrame([(i, t, len(t or ""), 0, 0) for i, t in rows], "doc_id long, text string, n_chars long, gone_id int, leak_id int").repartition(3)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    order = lambda rows: sorted(rows, key=str)
    stages = dict(corpus_pipeline.STAGES)
    got = {name: order((r.doc_id, r.text) for r in stages[name](spark, docs, str(tmp_path)).collect()) for name in ("near_dedup", "span_dedup", "decontaminate")}
    wordless = [r for r in rows if not r[1]]
    assert got["near_dedup"] == order([(1, near), (2, own["p"]), (3, own["q"]), (None, own["r"]), (None, own["s"]), rows[10], *wordless])
    assert got["decontaminate"] == order(r for r in rows if r != rows[10])
    assert len(got["span_dedup"]) == len(rows)
    assert stages["quality"](spark, docs, str(tmp_path)).columns == docs.columns
    assert sum(r.length for r in stages["packing"](spark, docs, str(tmp_path)).collect()) > 0


def test_import_guard():
    import __spark_entry__ as e

    assert {"pipeline", *(n for n in e.queries() if n.startswith("op"))} <= set(e.queries())
    assert len([n for n in e.queries() if re.match(r"op\d+_", n)]) == 13
