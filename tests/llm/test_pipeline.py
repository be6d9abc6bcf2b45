"""The corpus pipeline stage by stage against brute force, each stage on what the one before has kept."""

import corpus_pipeline
from test_dedup_ops import classes, line_removal
from test_packing import expected
from test_text_ops import contamination

from transitloom.llm import language


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # copies whose lines are broken elsewhere: only their shingles tell
    wide = [r for r in docs.orderBy("doc_id").collect() if r["text"] and r["text"].count("\n") > 5][:8]
    assert len(wide) == 8
    again = [(10_000 + r["doc_id"], " ".join(r["text"].split()), r["lang"], r["source"], r["n_chars"]) for r in wide]
    docs = docs.unionByName(spark.createDataFrame(again, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    stage = lambda name, df: spark.createDataFrame(stages[name](spark, df, sf_dir).toArrow())

    kept = stage("language_id", docs)
    unknown = {r["doc_id"] for r in language.predict(docs, language.train(docs)).where("lang_pred = 'und'").collect()}
    assert set(rows_of(kept)) <= set(rows_of(docs)) and not unknown & {r["doc_id"] for r in kept.collect()}
    assert kept.count() > 0.9 * (docs.count() - len(unknown))

    before = kept.collect()
    gone = line_removal([(r["doc_id"], r["text"]) for r in before])
    want = []
    for r in before:
        left = [t for k, t in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], k) not in gone]
        if left or r["text"] is None:
            want.append(tuple("\n".join(left) if c == "text" and r["text"] is not None else r[c] for c in docs.columns))
    kept = stage("line_dedup", kept)
    assert gone and rows_of(kept) == sorted(map(str, want))

    before = kept.collect()
    component = {d: c for d, _, c in classes([(r["doc_id"], r["text"]) for r in before], 5, 80)}
    kept = stage("ngram_jaccard_join", kept)
    want = [tuple(r) for r in before if component[str(r["doc_id"])] == str(r["doc_id"])]
    assert len(want) <= len(before) - 4 and rows_of(kept) == sorted(map(str, want))

    before = kept.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = stage("benchmark_decontamination", kept)
    want = [tuple(r) for r in before if not contamination(r["text"], items)[-1]]
    assert len(want) < len(before) and rows_of(kept) == sorted(map(str, want))

    pieces = stage("best_fit_packing", kept)
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces.collect())
    assert got == expected([(r["doc_id"], r["text"]) for r in kept.collect()], 2048)
    full = {}
    for r in pieces.collect():
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in full.values():
        ends = 0
        for a, n in sorted(own):
            assert a == ends
            ends += n
        assert ends <= 2048
