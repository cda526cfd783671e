"""Filter interactions, conversation repair and the chosen-path join, against brute force, on odd rows and on empty tables."""

import collections
import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from oracle import same
from tidewave.llm import filter_audit, near_dedup, registry, repair

# --- filter interactions ---


def test_polynomial_equals_all_orders():
    rng = random.Random(1)
    for _ in range(20):
        counts = {m: tuple(rng.randrange(9) for _ in range(3)) for m in range(32) if rng.random() < 0.7}
        documents = [m for m, c in counts.items() for _ in range(c[0])]
        rows, total = filter_audit.orders(counts), collections.Counter()
        assert len(rows) == 600 and len({r[0] for r in rows}) == 120
        for order, step, kept, removed, redundant, unique, good, toxic, _ in rows:
            before = sum(1 << "ABCDE".index(c) for c in order[: step - 1])
            bit = 1 << "ABCDE".index(order[step - 1])
            here = [m for m in counts if m & bit and not m & before]
            assert removed == sum(counts[m][0] for m in here) and good == sum(counts[m][1] for m in here) and toxic == sum(counts[m][2] for m in here)
            assert kept == sum(not m & (before | bit) for m in documents)
            assert redundant == sum(bool(m & bit and m & before) for m in documents) and unique == sum(m == bit for m in documents)
            total[order[step - 1]] += removed
        assert all(total[r[0][r[1] - 1]] == r[8] for r in rows)


def test_shapley_is_an_exact_integral():
    p = filter_audit.RemovalPolynomial({3: 1, 1: 1}, 2)
    assert (p.shapley(1), p.shapley(2)) == (Fraction(3, 2), Fraction(1, 2))
    assert [p.corner(s) for s in range(4)] == [0, 2, 1, 2]


def test_audit_equals_sql_on_odd_rows(spark, odd_documents, tmp_path):
    rng = random.Random(2)
    texts = [t for _, t in odd_documents] + ["A B C $ " * 60, "A B C $ " * 60, "\x0bword\x1c" * 3, " ".join(map(str, range(300))), "ÀÉ XYZ"]
    rows = [(None if i % 11 == 5 else i % 50, t, rng.choice([None, "", "web", "s'q"]), 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, mask int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i % 40, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(60)] + [(None, 1, 1, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string").write.parquet(f"{tmp_path}/labels.parquet")
    same(registry.QUERIES["op11_filter_interaction_audit"](spark, str(tmp_path)), filter_audit.OP11_SQL, str(tmp_path))


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(nothing.withColumn("source", F.lit("x")), labels).count() == 0


# --- conversation repair ---


def _all_repairs(rows):
    """(cost, audit, text) of the best edits, by trying all with at most three insertions before each turn and at the end."""
    seen, cells = set(), []
    for _, role, text in rows:
        cells.append((role, text, repair.fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    grown = [(0, "", "", ())]  # cost, audit, initials, lines
    for i in range(len(cells) + 1):
        for _ in range(3):
            grown += [(c + 2, a + "I", s + r[0], out + ((r, ""),)) for c, a, s, out in grown for r in ("user", "assistant")]
            grown = list(dict.fromkeys(grown))
        grown = [g for g in grown if repair_like(g[2])]
        if i == len(cells):
            break
        role, text, fault = cells[i]
        after = [(c + 3, a + "D", s, out) for c, a, s, out in grown]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            late = fault == repair.TRUNCATED
            after += [(c + late, a + "K", s + role[:1], out + ((role, text),)) for c, a, s, out in grown if role[:1] in ("s", "u", "a")]
            after += [(c + 2 + late, a + "R", s + r[0], out + ((r, text),)) for c, a, s, out in grown for r in ("user", "assistant")]
        best = min(c for c, *_ in after) + 12
        grown = [g for g in dict.fromkeys(after) if g[0] <= best and repair_like(g[2])]
    done = [g for g in grown if not g[2] or (g[2].lstrip("s") and len(g[2].lstrip("s")) % 2 == 0)]
    cost, audit, _, out = min(done, key=lambda g: g[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def repair_like(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return all(c == "ua"[k % 2] for k, c in enumerate(rest))


def _turns(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "ua"]
    return [(rng.choice([None, 1, 2, 3, 7]), rng.choices(roles, [8, 8, 2, 1, 1, 1])[0], rng.choice(["Yes.", "No!", "so", "", " \n", "What? ", "ok.\x0b", "é"])) for _ in range(n)]


def test_repair_equals_all_edits():
    rng = random.Random(4)
    for n in [0, 1, 2, 3] * 25:
        rows = _turns(rng, n)
        *_, cost, audit, digest = repair.repaired(rows)
        wanted = _all_repairs(rows)
        assert (cost, audit) == wanted[:2]
        assert digest == hashlib.sha256(wanted[2].encode()).hexdigest()


def test_chained_segments_equal_one_search():
    rng = random.Random(5)
    for _ in range(200):
        rows = _turns(rng, rng.randrange(1, 30))
        seen, cells, facts = set(), [], repair.Facts()
        for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            cells.append((role[:1], repair.fault_of(text, (role, text) in seen), turn))
            seen.add((role, text))
        whole = repair.search([c[:2] for c in cells], repair.START, whole=True)[0]
        cuts = [0, *sorted(rng.sample(range(len(cells) + 1), min(3, len(cells)))), len(cells)]
        chain, parts, at_once = repair.Chain(), [], repair.Facts()
        for i, f, t in cells:
            at_once.add(t, i, f)
        for a, b in itertools.pairwise(cuts):
            own = repair.Facts()
            for i, f, t in cells[a:b]:
                own.add(t, i, f)
            facts.join(own)
            parts.append([(e, s, c, x) for e in range(4) for s, c, x in repair.search([c[:2] for c in cells[a:b]], e, whole=False)])
            chain.add(parts[-1])
        cost, states, closing = chain.end()
        audit = "".join(next(x for e, s, _, x in ways if (e, s) == state) for ways, state in zip(parts, states)) + closing
        assert (cost, audit) == whole[1:] and facts.row() == at_once.row()


def _plain(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest())
    return {conv: repair.repaired(sorted(own, key=order)) for conv, own in by.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_repair_of_long_and_odd_conversations(spark, parts):
    """A conversation beyond a segment, one cut by ranges, nulls everywhere, repeated rows, clashing columns."""
    rng = random.Random(6)
    rows = [(1, None if k % 500 == 3 else k // 3, *r[1:]) for k, r in enumerate(_turns(rng, 5_000))]
    rows += [(2, k, "user", f"line {k}" + "." * (k % 2)) for k in range(2_500)]
    rows += [(c, *r) for c in [None, 3, 4, 5, 6, 7] for r in _turns(rng, 7)] + [(8, None, None, None)] * 2 + [(9, 1, "user", "x" * 50_000), (9, 2, "assistant", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, at int, gone string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == _plain(rows)


def test_damaged_conversations_equal_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None]), f"{rng.choice(['a', 'b', None, ' '])}{k}{rng.choice(['.', '?', ''])}" if rng.random() < 0.9 else None) for c in [None, *range(300)] for k in range(rng.randrange(1, 5))]
    rows = list({r[:2]: r for r in rows}.values())  # the order of rows of one number is this library's own
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    frame = registry.QUERIES["op12_conversation_structure_repair"](spark, str(tmp_path))
    same(frame, repair.OP12_SQL, str(tmp_path))
    lost = [r for r in frame.collect() if not r["audit"]]
    assert any(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["gaps"] == r["cost"] == 0 for r in lost)


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- chosen paths ---


def _components(rows, words=2):
    def grams(text):
        ws = (text or "").encode().lower().split()
        return {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set())

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[top(k)] = min(i, least.get(top(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        own = least.get(top(k)) if sets[k] else i
        out.append((i, len(sets[k]), own, i == own))
    return collections.Counter(out)


def _near(rng, base, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in base.split())


def test_near_dedup_equals_brute_force_on_odd_rows(spark, odd, odd_documents, nothing):
    found = near_dedup.near_duplicates(odd)
    assert collections.Counter(map(tuple, found.collect())) == _components(odd_documents)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_finds_links_at_the_threshold(spark):
    """Groups whose members lie about the threshold, so that components hang on single links."""
    rng = random.Random(8)
    rows = []
    for g in range(60):
        base = prose(rng, rng.randrange(20, 200))
        rows += [(1000 * g + k, _near(rng, base, rng.choice([0.02, 0.05, 0.08]))) for k in range(8)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (0, 10**9):
        found = near_dedup.near_duplicates(frame, near_dedup.ChosenPathParameters(few=few)).collect()
        assert collections.Counter(map(tuple, found)) == _components(rows)


@pytest.mark.parametrize("disjoint", [False, True])
def test_large_groups_are_linked_in_blocks(spark, disjoint):
    """A group beyond a block: links that no pivot has are found by the members outside the first pivot's component."""
    block, m = 8, 120
    sets = [[*range(100), 1000 + k] for k in range(100)] + [[10_000 * k + j for j in range(50)] for k in range(100, m)]
    sets[110] = [*sets[109][:-1], 7]  # hangs on one other alone
    rows = [(5, k, m, np.array(sorted(x), dtype=np.uint64).tobytes()) for k, x in enumerate(sets)] + [(6, 500 + k, 2, np.array([1, 2], dtype=np.uint64).tobytes()) for k in range(2)]
    frame = spark.createDataFrame(rows, "key long, node long, m long, shingles binary")
    found = near_dedup.linked_within(frame, block, near_dedup._forests(near_dedup.ChosenPathParameters(), "shingles"), "shingles", disjoint)
    roots = {r["node"]: r["root"] for r in found.collect()}
    wanted = {k: 0 for k in range(100)} | {k: k for k in range(100, m)} | {110: 109, 500: 500, 501: 500}
    assert {k: roots.get(k, k) for k in wanted} == wanted


def test_trees_reach_the_target():
    p = near_dedup.ChosenPathParameters()
    assert abs(p.together - 0.9375) < 1e-9 and (1 - p.together) ** p.trees <= 1 - p.target_recall
    assert near_dedup.ChosenPathParameters(threshold=1.0).trees == 1
    with pytest.raises(ValueError):
        near_dedup.ChosenPathParameters(threshold=0.4).trees  # noqa: B018
