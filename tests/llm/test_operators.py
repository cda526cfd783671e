"""Operators that SQL can't express, against brute force, on odd rows and on empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import _spans, chat, decontamination, exact_dedup, jaccard_join, lm_scoring, packing, pii, secrets, toxicity, url_filters
from tidewave.llm._components import connected_components


# --- exact dedup ---


def test_dedup_keeps_one_row_of_each_text(odd, odd_documents):
    for keep, pick in (("smallest", min), ("largest", max)):
        found = exact_dedup.content_sort_dedup(odd, keep=keep).collect()
        assert len(found) == len(odd_documents)
        groups = collections.defaultdict(list)
        for i, t in odd_documents:
            groups[t or ""].append(i)
        kept = collections.Counter(r["row"]["text"] or "" for r in found if r["kept"])
        assert set(kept) == set(groups) and set(kept.values()) == {1}
        for r in found:
            own = groups[r["row"]["text"] or ""]
            named = [i for i in own if i is not None]
            assert r["group_size"] == len(own) and r["keep_id"] == (pick(named) if named else None)


def test_dedup_splits_hot_groups(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(300)]
    found = exact_dedup.content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()
    assert len(found) == 301 and min(r["row"]["doc_id"] for r in found) == 0


def test_dedup_splits_copies_of_one_identifier(spark):
    """Copies that share an identifier, or have none, are spread as well, and one of them stays."""
    rows = [(7 if i % 3 else None, "same text", i) for i in range(600)] + [(7, "same text", 1)] * 3 + [(1000 + i, f"other {i}", i) for i in range(100)]
    for docs in (rows, [(None, t, x) for _, t, x in rows[:600]]):
        frame = spark.createDataFrame(docs, "doc_id long, text string, extra int")
        found = exact_dedup.content_sort_dedup(frame, keep="largest").collect()
        kept = [r for r in found if r["kept"]]
        assert len(found) == len(docs) and len(kept) == len({t for _, t, _ in docs})
        hot = [r for r in kept if r["row"]["text"] == "same text"]
        assert hot[0]["row"]["doc_id"] == (7 if docs is rows else None) and hot[0]["group_size"] == sum(t == "same text" for _, t, _ in docs)


def test_dedup_spreads_rows_alike_in_all_columns(spark):
    rows = [(None, "same text")] * 20_000 + [(i, f"other {i}") for i in range(4_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.content_sort_dedup(frame)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id().alias("at")).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
    kept = found.where("kept").select("row.doc_id", "group_size").collect()
    assert len(kept) == 4_001 and [r["group_size"] for r in kept if r["doc_id"] is None] == [20_000]


# --- packing ---


def _fewest(lengths: tuple, limits) -> int:
    """The least number of sequences, by trying all."""

    def fits(own):
        return sum(own) <= limits.tokens and len(own) <= limits.documents and sum(x * x for x in own) <= limits.attention

    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        seen = set()
        for i, b in enumerate(bins):
            if tuple(b) not in seen and fits([*b, rest[0]]):
                seen.add(tuple(b))
                place(rest[1:], bins[:i] + [[*b, rest[0]]] + bins[i + 1 :])
        place(rest[1:], [*bins, [rest[0]]])

    place(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_against_the_optimum(score):
    """Near the fewest sequences that there can be, with each constraint binding in turn; ties and repeats included."""
    rng = random.Random(21)
    for limits in (packing.PackingLimits(20, 20, 400.0, score=score), packing.PackingLimits(20, 2, 400.0, score=score), packing.PackingLimits(20, 20, 401.0, (1.0, 0.1, 1.0), score)):
        extra = used = 0
        for _ in range(40):
            lengths = tuple(rng.choice([1, 2, 3, 5, 5, 7, 9, 12, 20]) for _ in range(rng.randint(1, 9)))
            seq, _, n = packing.best_fit(np.array(lengths), limits)
            own = [[x for x, s in zip(lengths, seq) if s == k] for k in range(n)]
            assert all(sum(o) <= limits.tokens and len(o) <= limits.documents and sum(x * x for x in o) <= limits.attention for o in own)
            least = _fewest(lengths, limits)
            assert least <= n <= least + 1
            extra, used = extra + n - least, used + least
        assert extra <= 0.05 * used


def test_packing_with_binding_limits(spark):
    """Documents and attention bind as well as tokens, whatever bins the pieces are dealt to; ties and nulls are packed once each."""
    rows = [(i % 50 if i % 7 else None, 0, 0, 1 + i * i % 60, 5) for i in range(900)]
    limits = packing.PackingLimits(100, 4, 10_000.0, pieces_a_bin=200)
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE_SCHEMA), limits).toPandas()
    assert sorted(got["length"]) == sorted(r[3] for r in rows)
    by = got.groupby("sequence_id")["length"]
    assert by.sum().max() <= 100 and by.count().max() == 4 and by.apply(lambda x: (x.astype(float) ** 2).sum()).max() <= 10_000
    with pytest.raises(Exception, match="longer"):
        packing.pack(spark.createDataFrame([(1, 0, 0, 101, 1)], packing.PIECE_SCHEMA), limits).collect()


def test_token_ids_equal_the_tokenizers():
    rng = random.Random(1)
    letters = "abcXYZ éÉßİſK.,;:!?|#'’“…«»0129² çσςΣ\t\n\r\x1c日本𝒳-_@\"<|endoftext|>'s't're"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|>.", "don't. ab!…", ""]
    ids = packing.WordIds(packing.tokenizer_path())
    want = [e.ids for e in ids.tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == want


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_limit(score):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 3000)
    limits = packing.PackingLimits(tokens=100, documents=7, attention=10_000, score=score)
    seq, offset, used = packing.best_fit(lengths, limits)
    for s in range(used):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 7 and (own.astype(float) ** 2).sum() <= 10_000
        at = np.argsort(offset[seq == s])
        assert (np.cumsum(own[at]) - own[at] == offset[seq == s][at]).all()
    assert used <= 1.03 * lengths.sum() / 100 + 5


def test_chunks_are_looked_up_in_small_steps(monkeypatch):
    texts = [f"Word{k} word{k % 7}, and {'x' * (k % 50)}\n<|x|> {k}!" for k in range(200)] + [""]
    ids = packing.WordIds(packing.tokenizer_path())
    whole, sizes, some = [ids([t])[0] for t in texts], [], packing.WordIds._some
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", 500)
    monkeypatch.setattr(packing.WordIds, "_some", lambda self, part: sizes.append(len(part)) or some(self, part))
    ids.forget()
    assert ids(texts) == whole and sum(sizes) == len(texts) and max(sizes) < 50 and ids([]) == []


def test_packing_round_trip(odd, odd_documents):
    limits = packing.PackingLimits(tokens=64, attention=64.0**2, documents=64)
    rows = packing.pack_documents(odd, packing.tokenizer_path(), limits).toPandas()
    ids = packing.WordIds(packing.tokenizer_path())
    want = collections.Counter()
    for i, t in odd_documents:
        raw = np.append(np.frombuffer(ids([t or ""])[0], "<u4"), 1).astype("<u4")
        for k in range(0, len(raw), 64):
            want[(i, k // 64, k, len(raw[k : k + 64]), zlib.crc32(raw[k : k + 64].tobytes()))] += 1
    got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 64


# --- toxicity ---


def test_toxicity_on_held_out_rows(spark, nothing):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(40)] + (["idiot", "trash"] if bad else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(None, "idiot trash"), (9000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(frame, marks).collect()
    assert len(scored) == len(docs) and all(0 <= r["score"] <= 1 for r in scored)
    held = [r for r in scored if r["doc_id"] is not None and 400 <= r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert toxicity.score_toxicity(nothing, marks).count() == 0
    untrained = toxicity.score_toxicity(frame, marks.where("false")).agg(F.min("score"), F.max("score")).first()
    assert untrained[0] == pytest.approx(0.01, abs=1e-3) and untrained[0] == untrained[1]


def test_ftrl_equals_a_plain_version():
    """Training gives the weights of the textbook updates, coordinate by coordinate."""
    rng = random.Random(23)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(0, 12))), dtype=np.int32), rng.randint(0, 1)) for _ in range(60)]
    p = toxicity.FtrlParameters(bits=6, l1=0.3, epochs=3)
    at, w, bias = toxicity.train(rows, p)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    ones = sum(y for _, y in rows)
    b, bn = math.log((ones + 0.1) / (len(rows) - ones + 9.9)), 1.0
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for index, y in rows:
            own = {int(i): weight(int(i)) for i in index}
            g = 1 / (1 + math.exp(-(sum(own.values()) + b))) - y
            for i, v in own.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * v
                n[i] += g * g
            bn += g * g
            b -= p.alpha / (p.beta + math.sqrt(bn)) * g
    assert bias == pytest.approx(b) and dict(zip(at.tolist(), w)) == pytest.approx({i: weight(i) for i in sorted(z) if abs(z[i]) > p.l1})


def test_toxicity_features_equal_a_plain_version():
    """Words, neighbours and pairs with a word between, each by its own hash, never across texts."""
    texts = ["Aa, bb cc dd", "", "bb", "cc bb  aa", None]
    hashes = toxicity.WordHashes(toxicity._clean)
    index, doc = toxicity.features(hashes, [t or "" for t in texts], 20)
    got = {k: collections.Counter(index[doc == k].tolist()) for k in range(len(texts))}
    sizes = [len((t or "").split()) for t in texts]
    assert [sum(got[k].values()) for k in range(5)] == [n + max(0, n - 1) + max(0, n - 2) for n in sizes]
    assert sum((got[0] & got[3]).values()) == 3 and sum((got[2] & got[0]).values()) == sum((got[2] & got[3]).values()) == 1


def test_toxicity_odd_rows(spark, odd, odd_documents):
    """Repeated rows, nulls, very long texts and clashing names: a score for each row, by its text alone; filtering keeps the rest whole."""
    marks = spark.createDataFrame([(100 + k, k % 2, "x") for k in range(40)], "doc_id long, toxic int, text string")
    got = toxicity.score_toxicity(odd, marks).collect()
    by = collections.defaultdict(set)
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in odd_documents), key=str)
    for (i, t), r in zip(sorted(odd_documents, key=lambda x: str(x[0])), sorted(got, key=lambda r: str(r["doc_id"]))):
        by[r["doc_id"]].add(round(r["score"], 9))
    assert all(len(v) == 1 for k, v in by.items() if k is not None)
    clean = toxicity.keep_clean(odd, marks)
    assert clean.columns == odd.columns and clean.count() == sum(r["predicted"] == 0 for r in got)


# --- decontamination ---


def _edits(p: str, t: str, free: bool) -> int:
    prev = [0 if free else j for j in range(len(t) + 1)]
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev) if free else prev[-1]


def test_decontamination_equals_brute_force(spark, odd, nothing):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [(i, text(rng.choice([6, 30, 60, 120]))) for i in range(10)]
    docs = []
    for d in range(60):
        chars = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, int(len(chars) * 0.16))):
            j = rng.randrange(len(chars))
            chars[j : j + 1] = rng.choice([["x"], [], ["y", chars[j]]])
        docs.append((d, text(rng.randint(0, 150)) + "".join(chars) + text(rng.randint(0, 150))))
    docs += [(1000, None), (1001, "")]
    p = decontamination.LemmaParameters()
    bench = spark.createDataFrame(items + [(50, None), (51, " ")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, p).collect()}
    want = {}
    for d, t in docs:
        t = decontamination.normalise(t or "")
        for i, item in items:
            item = decontamination.normalise(item)
            edits = _edits(item, t, True)
            if edits <= p.budget(len(item), min(p.q, len(item))):
                want[d, i] = edits
                r = found[d, i]
                assert r["edits"] == edits == _edits(item, t[r["start"] : r["end"]], False)
    assert set(found) == set(want)
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(odd, bench.where("false")).count() == 0


@pytest.mark.parametrize("size", [6, 10, 19, 20, 25, 30, 39, 60])
def test_decontamination_keeps_the_budget_of_short_items(spark, size):
    """A tenth of the characters may differ, rounded down, whatever the length of the item."""
    rng = random.Random(size)
    item = "".join(rng.choice("abcdefghij") for _ in range(size))
    docs = []
    for changes in (size // 10, size // 10 + 1):
        chars = list(item)
        for k in range(changes):
            chars[(k * size) // changes + size // (2 * changes)] = "z"
        docs.append((changes, "y" * 40 + "".join(chars) + "y" * 40))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["edits"], r["start"], r["end"]) for r in found] == [(size // 10, size // 10, 40, 40 + size)]


def test_decontamination_numbers_of_any_size():
    """More pairs of documents and items at once than 31 bits number."""
    rng = random.Random(21)
    items = [(k, "".join(rng.choices("abcdefghijklmnop", k=12))) for k in range(300_000)]
    wanted = [(d, rng.randrange(len(items))) for d in range(9_000)]
    found = decontamination._found(decontamination._indexes(items, decontamination.LemmaParameters()), [items[i][1] for _, i in wanted])
    assert set(wanted) <= {(d, i) for d, i, *_ in found}


def test_decontamination_odd_rows(spark, odd, odd_documents):
    """Null, repeated and very long rows, ties, and clashing names: each row that holds an item is named."""
    by = collections.Counter()
    items = [(1, odd_documents[0][1][:200]), (1, odd_documents[0][1][:200]), (None, "x" * 300), (2, odd_documents[12][1][-90:])]
    for i, t in odd_documents:
        for item, x in items:
            by[i, item] += _edits(x, decontamination.normalise(t or ""), True) <= len(x) // 10 if len(t or "") < 5000 else x in t
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("other"))
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, bench).collect())
    assert got == collections.Counter({k: n for k, n in by.items() if n})


# --- Jaccard join ---


def _sets(rows):
    out = {}
    for key, t in rows:
        w = (t or "").lower().split()
        out[key] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def test_jaccard_groups_equal_brute_force(spark, nothing):
    rng = random.Random(6)
    rows, words = [], [f"w{k}" for k in range(500)]
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(30 if g == 1 else 8):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "One  two"), (504, "two one")]
    sets = _sets(rows)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    link = collections.defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (x == y or len(x & y) >= 0.8 * len(x | y) > 0):
                link[a].add(b)
                link[b].add(a)
    assert {k: r["n_links"] for k, r in got.items()} == {k: len(link[k]) for k in sets}
    root = {k: k for k in sets}
    for _ in range(len(sets)):
        root = {k: min([root[k], *(root[x] for x in link[k])]) for k in sets}
    assert {k: r["class_id"] for k, r in got.items()} == root
    assert jaccard_join.jaccard_groups(nothing).count() == 0


def _links(rows):
    """Links of each row by position, copies included, by comparing all rows."""
    sets = [_sets([(0, t)])[0] for _, t in rows]
    return [sum(j != k and (x == y or len(x & y) >= 0.8 * len(x | y) > 0) for k, y in enumerate(sets)) for j, x in enumerate(sets)]


def test_jaccard_texts_under_one_identifier(spark, odd, odd_documents):
    """Rows are told by their texts: two texts under one identifier, and rows without one, lose and gain no links."""
    rng = random.Random(16)
    a, b = ([f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(2))
    rows = [(6, " ".join(a)), (6, " ".join(b)), (7, " ".join(a[:-1] + ["x"])), (8, " ".join(b[:-1] + ["y"])), (None, " ".join(a[:-2])), (9, " ".join(b + ["z"]))]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(6, 2, 6), (6, 2, 6), (7, 2, 6), (8, 2, 6), (9, 2, 6), (None, 2, 6)]
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in got), key=str) == sorted(want, key=str)
    got = jaccard_join.jaccard_groups(odd).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=str) == sorted(((i, n) for (i, _), n in zip(odd_documents, _links(odd_documents))), key=str)


def test_prefix_follows_the_similarities():
    """Close copies are met by whole labels; the nearer the links are to the threshold, the shorter the prefix."""
    p = jaccard_join.ForestParameters()
    n = p.trees * p.label
    close, near = p.measured({n - 1: 100_000}), p.measured({int(0.8 * n) + 1: 100, n - 1: 100})
    assert close == (p.label, pytest.approx(1)) and near[0] < p.label and near[1] >= p.target_recall
    assert p.measured({})[0] == p.depth and p.measured({})[1] == pytest.approx(p.recall(p.depth)) and p.depth <= near[0]
    assert p.measured({n - 1: 3})[0] == p.depth


def test_jaccard_odd_rows(odd, odd_documents):
    assert jaccard_join.jaccard_groups(odd).count() == len(odd_documents)


def test_recall_shortens_the_prefix():
    strict, loose = jaccard_join.ForestParameters(), jaccard_join.ForestParameters(target_recall=0.9)
    assert strict.depth < loose.depth and strict.recall(strict.depth) >= strict.target_recall


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, k) for k in range(100, 160)] + [(None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(len(root)):
        for u, v in edges:
            if u is not None:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- language model ---


def test_lm_base_equals_brute_force(odd, odd_documents, nothing):
    rows = odd.withColumn("train", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)))
    got = lm_scoring.score_documents(rows, "train").collect()
    assert len(got) == len(odd_documents)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
    counts = collections.Counter(w for i, t in odd_documents if i is not None and i % 3 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 5)) for i, t in odd_documents)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == total for r in got)
    assert lm_scoring.score_documents(nothing.withColumn("train", F.lit(True)), "train").count() == 0


def test_lm_learns(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)), i % 5 != 0) for i in range(150)] + [(999, " ".join("zqxjv" for _ in range(60)), False)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string, train boolean"), "train").collect()}
    known = np.mean([got[i] for i in range(0, 150, 5)])
    assert known < 2.0 < got[999]


def _lm_table(texts: list[bytes]):
    laid = lm_scoring.Laid(texts)
    keys, n = lm_scoring.tally(laid.keys(), np.ones(len(laid.owner), dtype=bool))
    low = lm_scoring._summed(keys >> np.uint64(45) << np.uint64(9) | keys & np.uint64(511), n)
    return keys, n, low, lm_scoring.Code(np.bincount((low[0] & np.uint64(511)).astype(int), weights=low[1], minlength=257))


def test_lm_symbols_sum_to_one():
    """The probabilities of all bytes and of the end after a context sum to one, learnt or not."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "ca", "\u00e9t"]) for _ in range(30)).encode() for _ in range(20)]
    keys, n, low, code = _lm_table(texts)
    own = np.unique(keys >> np.uint64(9))[::7]
    whole = np.concatenate([keys, (own[:, None] << np.uint64(9) | np.arange(257, dtype=np.uint64)).ravel()])
    whole, n = lm_scoring._summed(whole, np.concatenate([n, np.zeros(len(own) * 257, dtype=np.int64)]))
    low = lm_scoring._summed(np.concatenate([low[0], np.unique(whole >> np.uint64(45) << np.uint64(9) | whole & np.uint64(511))]), np.concatenate([low[1], np.zeros(len(np.unique(whole >> np.uint64(45) << np.uint64(9) | whole & np.uint64(511))), dtype=np.int64)]))
    p = lm_scoring.MixingParameters()
    for mixer in (lm_scoring.Mixer(), lm_scoring.learnt(whole, n, low, code, p)):
        said = 10 ** lm_scoring.scored(whole, n, low, code, p, mixer)
        for c in own:
            assert said[whole >> np.uint64(9) == c].sum() == pytest.approx(1)


def test_lm_context_crosses_words(spark):
    """A learnt order of words scores above the same words in any other order."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    phrase = " ".join(words)
    mixed = [" ".join(rng.sample(words, len(words))) for _ in range(4)]
    docs = [(i, phrase, True) for i in range(30)] + [(100, phrase, False)] + [(200 + i, x, False) for i, x in enumerate(mixed)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string, train boolean"), "train").collect()}
    assert all(got[100] > got[200 + i] + 20 for i in range(len(mixed)))


def _brute(code, texts: list[bytes], p, mixer, without: bool):
    """(text, depth, inputs, gate, bit, node) of every bit, one by one, from dictionaries of counts."""
    counts = collections.Counter()
    symbols = [[257] * 6 + list(t) + [256] for t in texts]
    for s in symbols:
        for i in range(6, len(s)):
            for order in range(1, 7):
                for d in range(code.length[s[i]] + 1):
                    counts[order, tuple(s[i - order : i]), tuple(code.bit[s[i], :d])] += 1
    for k, s in enumerate(symbols):
        for i in range(6, len(s)):
            for d in range(code.length[s[i]]):
                path, x, seen = tuple(code.bit[s[i], : d + 1]), [], {}
                for order in range(1, 7):
                    here, on = counts[order, tuple(s[i - order : i]), path[:-1]], counts[order, tuple(s[i - order : i]), path]
                    x.append(math.log((max(0, on - without) + p.prior) / (here - on + p.prior)))
                    seen[order] = int(math.log2(max(0, on - without) + here - on + 1))
                gate = min(d, lm_scoring.DEPTHS - 1) * lm_scoring.LEVELS + min(4, seen[6]) * 4 + min(3, seen[4] // 3)
                yield k, d, x, gate, path[-1], code.node[s[i], d]


def test_lm_equals_a_mixer_bit_by_bit():
    """Scores of whole texts equal those of a plain mixer that goes through them bit by bit."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "ca", "\u00e9t"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(12)]
    keys, n, low, code = _lm_table(texts)
    p = lm_scoring.MixingParameters()
    mixer = lm_scoring.learnt(keys, n, low, code, p)
    assert np.abs(mixer.weights - 0.25).max() > 0.05
    laid = lm_scoring.Laid(texts)
    got = np.bincount(laid.owner, weights=lm_scoring.scored(keys, n, low, code, p, mixer)[np.searchsorted(keys, laid.keys())])
    want = np.zeros(len(texts))
    for k, _, x, gate, bit, node in _brute(code, texts, p, mixer, False):
        t = min(7.999, max(-7.999, float(mixer.weights[gate] @ np.array(x))))
        place = ((t if bit else -t) + 8) * (lm_scoring.BUCKETS - 1) / 16
        low_cell = int(place)
        one = mixer.map[node, low_cell] * (1 - place + low_cell) + mixer.map[node, low_cell + 1] * (place - low_cell)
        want[k] += math.log10(min(1 - 1e-6, max(1e-6, (1 / (1 + math.exp(-t)) + (one if bit else 1 - one)) / 2)))
    assert np.allclose(got, want, atol=1e-3)


def test_lm_learns_from_every_occurrence(monkeypatch):
    """Weights and map see each bit of the training texts as often as it occurs, with its own occurrence taken out."""
    texts = [b"ab " * 300, b"abba", b""]
    keys, n, low, code = _lm_table(texts)
    p, got, want = lm_scoring.MixingParameters(), collections.Counter(), collections.Counter()

    def seen(self, x, gate, bit, node, weight, rate):
        for v, g, b, m, w in zip(x, gate, bit, node, weight):
            got[tuple(np.round(v, 4)), int(g), int(b), int(m)] += w

    monkeypatch.setattr(lm_scoring.Mixer, "learn", seen)
    lm_scoring.learnt(keys, n, low, code, p)
    for _, _, x, gate, bit, node in _brute(code, texts, p, None, True):
        want[tuple(np.round(np.array(x, dtype=np.float32), 4)), gate, int(bit), int(node)] += 1
    assert got == want


def test_lm_same_scores_however_it_is_dealt(spark, monkeypatch):
    """Words, counts and base scores are equal for any chunks and shares; scores differ by the averaging of weights only."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200))), i % 6 != 0) for i in range(300)], "doc_id long, text string, train boolean")
    p = lm_scoring.MixingParameters(batch=256)
    one = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, "train", p).collect()}
    for name, value in (("CHUNK", 9_000), ("SHARE", 40_000), ("MERGED", 3)):
        monkeypatch.setattr(lm_scoring, name, value)
    many = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, "train", p).collect()}
    assert set(one) == set(many)
    for k, r in one.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (many[k]["n_tokens"], many[k]["n_known"], many[k]["train_tokens"])
        assert many[k]["base_score"] == pytest.approx(r["base_score"]) and many[k]["score"] == pytest.approx(r["score"], rel=0.05, abs=1)
    assert sum(r["score"] for r in many.values()) == pytest.approx(sum(r["score"] for r in one.values()), rel=0.01)


# --- personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def _base(text: str) -> list[str]:
    count = lambda t: sum(c in "0123456789" for c in t)
    good = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 13 <= count(t) <= 19 and _luhn(t), "phone": lambda t: 9 <= count(t) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if good[k](m[0])]


def test_pii_base_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    parts = ["1", "2", "34", "4111 1111 1111 1111", "+", "(", ")", "-", " ", ".", "@", "a", "B_%", "a@b.c", "x.y@z.w.v", "256", "0", "", "é", "𝒳", "%d@e.f", "--", "+1 (555) 555-1234", "1.2.3.4", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(700)] + [None, "", "1" * 20_000, "a" * 30_000, "1-" * 1500, "call 555-010-2345 now"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = _base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(",")) if base else True
    assert got[len(texts) - 1]["spans"] == "phone:5:17"


def test_pii_selection_is_calibrated(spark):
    p = pii.BoostingParameters(sentences=3000, rounds=15)
    start, trees, cuts = pii.train(spark, p)
    assert len(trees) == 15 and all(math.isfinite(cuts[k]) for k in ("email", "phone"))


def test_pii_trees_as_columns(spark):
    """A CASE expression of a tree gives what the tree gives; margins that tie are let in together."""
    p = pii.BoostingParameters(sentences=2000, rounds=6)
    start, trees, cuts = pii.train(spark, p)
    found = pii.candidates(pii.synthetic_sentences(spark, 2000), ["says", "held"]).select("says", "held", F.explode("spans").alias("s")).select((F.col("says") == F.col("s.kind")).cast("int").alias("label"), "held", "s.kind", pii.features_of(F.col("s")).alias("x"))
    rows = found.select("*", *[pii._case(t, F.col("x")).alias(f"t{k}") for k, t in enumerate(trees)]).collect()
    assert len(rows) > 500
    margins = collections.defaultdict(list)
    for r in rows:
        leaves = [pii._leaf(t, tuple(r["x"])) for t in trees]
        assert [r[f"t{k}"] for k in range(len(trees))] == leaves
        margins[r["kind"], r["held"]].append((start + sum(leaves), r["label"]))
    for kind in pii.KINDS:
        chosen = [y for m, y in margins[kind, True] if m >= cuts[kind]]
        assert not chosen or np.mean(chosen) >= p.precision


def test_pii_beyond_the_base(spark):
    """Written-out and local forms in a context are found, things that are counted are not."""
    texts = ["please mail kim(at)example.com today", "call (555) 010-2345 now", "the ip 10[.]0[.]3[.]7 is down", "order 555-010-2345 was sent", "version 400(.)1(.)2(.)3", "tel 0044 7911 123 457"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["all"]] for r in pii.pii_spans(docs).collect()}
    assert got[0] == [("email", "kim(at)example.com")] and got[1] == [("phone", "(555) 010-2345")] and got[2] == [("ip", "10[.]0[.]3[.]7")]
    assert got[3] == [] and got[4] == [] and got[5] == [("phone", "0044 7911 123 457")]


# --- pieces of the native operators ---


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert q("[0-9a-f]{24,}") is True and q("ab?") is True
    assert q("(abc|def)x") == ("or", (("and", ("abc", "bcx")), ("and", ("def", "efx"))))
    assert q("abc(def)*ghi") == ("and", ("abc", "ghi")) and q("(?:abc)+") == "abc"


def _fulfils(query, text: str) -> bool:
    if query is True or isinstance(query, str):
        return query is True or query in text.lower()
    return (all if query[0] == "and" else any)(_fulfils(q, text) for q in query[1])


def test_trigram_queries_admit_every_match():
    """Whatever a rule matches fulfils its query, and expressions outside the parser's reach are refused."""
    hits = ["password = 'abcdef", "apikey:abcdef", "API_KEY=ab", "AKIA" + "Z9" * 8, "ghp_" + "a" * 36, "xoxb-1234567890", "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "token\"=x", "0" * 24]
    for rule in secrets.RULES:
        query, own = secrets.trigram_query(rule.pattern), [h for h in hits if re.search(rule.pattern, h)]
        assert own and all(_fulfils(query, h) for h in own)
    q = secrets.trigram_query
    assert q(r"a[b]c\x64(?=zzz)^e$") == ("and", ("abc", "bcd", "cde")) and q(r"(?i)KEY\d{2,}?x") == "key" and q("ab{2}c") is True
    for bad in ("(ab", "ab)", r"\q"):
        with pytest.raises(ValueError):
            q(bad)


def test_stored_postings_serve_the_scan(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(700, "token=abcdefgh AKIA" + "Q" * 16, 0, "s")], odd.schema))
    index = secrets.postings(docs, secrets.grams_of())
    own = lambda df: sorted(map(str, df.collect()))
    assert own(secrets.secret_spans(docs, index=index)) == own(secrets.secret_spans(docs))


def test_places_of_many_matches(spark):
    """A text with very many matches takes time in proportion to them."""
    text = "é" + "a1 \ue001bb22 " * 30_000
    got = spark.createDataFrame([(text,)], "t string").select(_spans.matches(F.col("t"), "[0-9]+").alias("m")).select(F.explode(_spans.placed(F.col("m"))).alias("s")).select("s.*").collect()
    assert [(r["start"], r["end"], r["hit"]) for r in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_escape_round_trip(spark):
    texts = ["", "\\", "<|", "<\\|", "\\<|x|>\\\\", "<<|im_end|>\n", "é<|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back"))
    for r in df.collect():
        assert r["back"] == r["t"] and "<|" not in r["e"]


def test_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, i, ["user", "assistant"][i % 2], "q" * (i * 37 % 800)) for i in range(1, 80)]
    w = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.WindowBudget(600, 120)).collect()
    assert len(w) > 3 and all(r["tokens"] <= 600 for r in w)
    assert sum(r["n_new"] for r in w) == 80 and all(r["formatted"].startswith("<|im_start|>system\n") for r in w)


def test_url_rules():
    with pytest.raises(ValueError):
        url_filters.UrlRule("deny", "com")


def test_url_odd_rows(spark):
    """Repeated rows, nulls, urls without a scheme, very long ones and clashing names are judged each; edges given from outside count."""
    long = "http://a.com/en/" + "x" * 50_000
    rows = [(1, long, "a"), (1, long, "a"), (None, None, None), (2, "nope", "b"), (3, "http://b.net/q", "c"), (4, "http://c.info/", "d")]
    pages = spark.createDataFrame([(*r, "k", "r") for r in rows], "page_id long, url string, html string, key string, rule string")
    edges = spark.createDataFrame([("http://c.info", "http://z.org/es/1"), (None, "http://c.info")], "source string, target string")
    got = sorted(((r["page_id"], r["verdict"], r["rule"]) for r in url_filters.url_verdicts(pages, redirects=edges).collect()), key=str)
    assert got == sorted([(1, "block", "com/en/")] * 2 + [(None, "allow", None), (2, "allow", None), (3, "allow", None), (4, "block", None)], key=str)


def test_chat_clashing_columns(spark):
    rows = [(1, 0, "user", "a", "x", 5), (1, 1, "assistant", "b", "y", 6)]
    got = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string, n int")).collect()
    assert [r["formatted"] for r in got] == ["<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"] and got[0]["tokens"] == 10


def test_empty_tables(spark, nothing, tmp_path):
    assert exact_dedup.content_sort_dedup(nothing).count() == 0
    assert packing.pack_documents(nothing, packing.tokenizer_path()).count() == 0
    assert secrets.secret_spans(nothing).count() == 0
    assert pii.pii_spans(nothing, pii.BoostingParameters(sentences=300, rounds=2)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.url_verdicts(pages).count() == 0
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_long_turn_stays_alone(spark):
    """A turn beyond the budget is a window of its own; the ordinary turns around it share theirs."""
    said = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * (2000 if i == 10 else 20)) for i in range(20)]
    w = sorted(chat.format_windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), chat.WindowBudget(600, 120)).collect(), key=lambda r: r["window"])
    assert [r["n_new"] for r in w] == [10, 1, 9]
    assert sorted(r["tokens"] > 600 for r in w) == [False, False, True]
    said = [(None, i, "system" if i == 0 else "user", "word " * 40) for i in range(40)]
    w = chat.format_windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), chat.WindowBudget(600, 120)).collect()
    assert sum(r["n_new"] for r in w) == 40 and all(600 - 54 < r["tokens"] <= 600 for r in w if r["window"] < len(w) - 1)


def _greedy(turns, budget, segment):
    """(context, new) turns of each window, turn by turn; ``turns`` are (role, text) in order."""
    size = lambda t: -(-len(t[1].encode()) // 4) + 4
    ends, total = [], 0
    for t in turns:
        total += size(t)
        ends.append(total)
    begin = [e - size(t) for e, t in zip(ends, turns)]
    system = [0] if turns[0][0] == "system" else []
    cells = [b // segment if total > budget.tokens else 0 for b in begin]
    out, context, new = [], [], []
    for i in range(len(turns)):
        used = sum(size(turns[k]) for k in context + new) + size(turns[i])
        if i and ((total > budget.tokens and used > budget.tokens and new) or cells[i] != cells[i - 1]):
            out.append((context, new))
            earlier = max((c for c in cells[:i] if c < cells[i]), default=None)
            context = system + [k for k in range(i) if begin[i] - begin[k] <= budget.history and k not in system and cells[k] in (cells[i], earlier)]
            new = []
        new.append(i)
    return [*out, (context, new)]


def test_chat_windows_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in range(40):
        longest = rng.choice([30, 200, 1500, 6000])
        for i in range(rng.choice([1, 4, 60, 300])):
            rows.append((c if c else None, i, "system" if i == 0 and c % 3 else rng.choice(["user", "assistant"]), "wé" * rng.randrange(longest)))
    budget = chat.WindowBudget(600, 120)
    got = collections.defaultdict(list)
    for r in chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), budget).collect():
        got[r["conv_id"]].append(r)
    by = collections.defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, text))
    for c, turns in by.items():
        own, want = sorted(got[c], key=lambda r: r["window"]), _greedy(turns, budget, chat.SEGMENT * budget.tokens)
        assert [r["window"] for r in own] == list(range(len(want)))
        assert [(r["n_context"], r["n_new"]) for r in own] == [(len(a), len(b)) for a, b in want]
        for r, (a, b) in zip(own, want):
            assert r["formatted"] == "".join(f"<|im_start|>{turns[k][0]}\n{turns[k][1]}<|im_end|>\n" for k in a + b)
            assert [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == [turns[k][1] for k in b if turns[k][0] == "assistant"]
