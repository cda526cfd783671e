"""The pipeline against a brute-force version on a small fixture."""

import collections
import random

import corpus_pipeline as c
from tidewave.llm import decontamination, packing, toxicity


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(0, text(30))]
    docs, labels = [], []
    for i in range(160):
        bad = i % 8 == 0
        docs.append((i, text(60) + (" idiot trash scum" if bad else "")))
        labels.append((i, int(bad)))
    docs += [(200, docs[1][1]), (201, docs[1][1]), (202, docs[2][1] + " tail"), (203, text(20) + " " + bench[0][1] + " " + text(20)), (204, None), (205, "")]
    full = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.score_toxicity(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()
    rejected = {r["doc_id"] for r in scored}
    assert rejected >= {i for i in range(0, 160, 8)} and len(rejected) <= 22
    left = [(i, t) for i, t in docs if i not in rejected]
    groups = collections.defaultdict(list)
    for i, t in left:
        groups[t or ""].append(i)
    left = [(i, t) for i, t in left if i == max(groups[t or ""])]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in left}
    dropped = {b for a in sets for b in sets if a < b and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    left = [(i, t) for i, t in left if i not in dropped]
    left = [(i, t) for i, t in left if decontamination.normalise(bench[0][1]) not in decontamination.normalise(t or "")]
    assert 203 not in dict(left) and 202 not in dict(left) and 201 in dict(left)

    out = c.run(spark, str(tmp_path)).toPandas()
    assert sorted(out["doc_id"]) == sorted(i for i, _ in left)
    assert out.groupby("sequence_id")["length"].sum().max() <= packing.PackingLimits().tokens


def test_stages_pass_documents_on(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in c.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in c.STAGES[:-1]:
        for docs in (odd, nothing):
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
