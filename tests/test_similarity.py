from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import similarity as sim


def brute_run(a, b):
    best = 0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


def test_longest_common_run_against_definition(spark):
    rnd = random.Random(3)
    seqs = {}
    for i in range(300):
        k = rnd.choice([1, 2, 3, 8])
        for side in (0, 1):
            seqs[2 * i + side] = [rnd.randrange(k) for _ in range(rnd.randrange(0, 25))]
    frame = spark.createDataFrame(list(seqs.items()), "doc int, seq array<bigint>")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(300)], "a int, b int")
    got = {r.a: r.run for r in sim.longest_common_run(pairs, frame).collect()}
    assert got == {2 * i: brute_run(seqs[2 * i], seqs[2 * i + 1]) for i in range(300)}


def test_run_of_repeated_lines_stays_cheap(spark):
    rnd = random.Random(8)
    same, other = [7] * 100_000, [rnd.randrange(1 << 60) for _ in range(5000)]
    frame = spark.createDataFrame([(1, same), (2, [*same[:60_000], 8, *other, *same]), (3, other[100:4000] + same[:9]), (4, [])], "doc int, seq array<bigint>")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 4), (1, 9)], "a int, b int")
    start = time.time()
    got = {(r.a, r.b): r.run for r in sim.longest_common_run(pairs, frame).collect()}
    assert got == {(1, 2): 100_000, (2, 3): 3900, (1, 3): 9, (1, 4): 0, (1, 9): 0}
    assert time.time() - start < 60


def test_lengths_around_powers_of_two(spark):
    runs = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65]
    seqs = [(i, list(range(n)) + [1000 + i] * 3) for i, n in enumerate(runs)] + [(99, [5000, *range(200), 5001])]
    got = sim.longest_common_run(spark.createDataFrame([(i, 99) for i in range(len(runs))], "a int, b int"), spark.createDataFrame(seqs, "doc int, seq array<bigint>"))
    assert {r.a: r.run for r in got.collect()} == dict(enumerate(runs))


def test_any_number_of_copies_is_found(spark, rows):
    for n in (2, 6, 7, 500):
        docs = [(d, [1, 2, 3]) for d in range(n)] + [(1000, [3, 4]), (1001, [9])]
        got = set(rows(sim.candidate_pairs(spark.createDataFrame(docs, "doc int, hashes array<bigint>"))))
        assert got == {(0, d) for d in range(1, n)} | {(0, 1000)}


def line(i):
    return f"const value{i} = compute({i}, other{i});"


def test_candidate_pairs_against_brute_force(spark, rows):
    rnd = random.Random(5)
    docs = {d: {rnd.randrange(40) for _ in range(rnd.randrange(1, 12))} | {99} for d in range(40)}
    df = spark.createDataFrame([(d, sorted(h)) for d, h in docs.items()], "doc int, hashes array<bigint>")
    first = {d: min(e for e in docs if docs[e] == docs[d]) for d in docs}
    freq = {}
    for d, h in docs.items():
        for x in h if first[d] == d else ():
            freq[x] = freq.get(x, 0) + 1
    want = {
        (a, b)
        for a in docs
        for b in docs
        if a < b and first[a] == a and (first[b] == a or first[b] == b and any(2 <= freq[h] <= 6 for h in docs[a] & docs[b]))
    }
    assert set(rows(sim.candidate_pairs(df))) == want


def test_boilerplate_in_every_document_gives_no_pair(spark, rows):
    df = spark.createDataFrame([(d, [1, 1000 + d]) for d in range(50)], "doc int, hashes array<bigint>")
    assert rows(sim.candidate_pairs(df)) == []


def test_duplicates(spark, rows):
    shared = [line(i) for i in range(8)]
    own = lambda k: [f"let entirely{k}_{i} = another.thing{k}({i});" for i in range(30)]
    block_a = "\n".join(own("a") + shared + own("b"))
    block_b = "\n".join(own("c")[:3] + shared + own("d")[:3])
    scattered = "\n".join(x for pair in zip(shared, own("e")) for x in pair)
    clone = lambda p: "\n".join(
        f"function {p}{i}({p}x, {p}y) {{ if ({p}x > {i}) {{ return {p}y.{p}call({p}x + {i}) }} else {{ throw new Error('{p}') }} }}" for i in range(9)
    )
    docs = spark.createDataFrame(
        [("blockA", block_a), ("blockB", block_b), ("scattered", scattered), ("cloneA", clone("alpha")), ("cloneB", clone("beta")), ("tiny", "x")],
        "doc_id string, text string",
    )
    for algorithm in ("xxhash64", "md5", "fnv1a"):
        got = sim.duplicate_scores(docs, sketch_algorithm=algorithm)
        found = {(a, b): (run, via) for a, b, run, via in rows(got, "a", "b", "run", "via")}
        assert found[("blockA", "blockB")] == (8, "lines") or found[("blockA", "blockB")][1] == "both"
        assert found[("cloneA", "cloneB")] == (0, "structural")
        assert found.get(("blockA", "scattered"), (0, ""))[0] <= 1
    report = sim.duplicates(sim.duplicate_scores(docs)).collect()
    assert {(r["a"], r["b"]) for r in report} >= {("blockA", "blockB"), ("cloneA", "cloneB")}


def test_sketch_against_plain_python(spark):
    marks = ["a", "z9", "A", "Z", "_x", "$y", "1.5", "9", "'q'", '"q"', "`q`", "if", "null", "@", "[", "{", "^", "~", "=>", "// no", "/* no */", "{", "%", "#", "é"]
    rng = random.Random(3)
    text = "\n".join(f"{rng.choice(marks)} {rng.choice(marks)} ;" for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, "a ; " * 59), (3, None), (4, "a ; " * 60)], "doc_id int, text string")
    tokens = []
    for t in re.findall(tx.TOKEN_RE, text):
        if not t.startswith(("//", "/*")):
            tokens.append("S" if t[0] in "`'\"" else "N" if t[0].isdigit() else "I" if re.match(r"[A-Za-z_$]", t) and t not in tx.KEYWORDS else t)
    shingles = {" ".join(tokens[i : i + 9]) for i in range(len(tokens) - 8)}
    expected = sorted(int(hashlib.md5(s.encode()).hexdigest()[:15], 16) for s in shingles)
    sketch = sim.minhash_sketch(docs, algorithm="md5")
    found = {r["doc"]: r["hashes"] for r in sketch.collect()}
    assert found.keys() == {1, 4} and found[1] == expected[:128] and len(expected) > 128
    # A token's kind needs no pattern, and only the hashes that stay are made numbers.
    plan = sketch._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("conv(") == 1


def test_every_pair_that_shares_enough_is_scored(spark, rows):
    shared = "\n".join(line(i) for i in range(8))
    docs = spark.createDataFrame([(i, shared + f"\n{line(100 + i)}") for i in range(4)], "doc_id int, text string")
    assert len(rows(sim.duplicate_scores(docs))) == 6


def test_disjoint_corpus(spark, rows):
    words = [[f"{p}{i}" for i in range(200)] for p in ("qa", "wb", "ec", "rd", "tf")]
    docs = spark.createDataFrame(
        [(i, "\n".join(" ".join(w[k : k + 5]) for k in range(0, 200, 5))) for i, w in enumerate(words)], "doc_id int, text string"
    )
    assert rows(sim.candidate_pairs(sim.line_sequences(docs))) == []
    assert tuple(sim.pairwise_disjoint(docs, tx.words(F.col("text"))).first()) == (True, 0)
    leaky = docs.withColumn("text", F.concat("text", F.lit(" common")))
    assert tuple(sim.pairwise_disjoint(leaky, tx.words(F.col("text"))).first()) == (False, 1)
    assert tuple(sim.pairwise_disjoint(leaky, tx.words(F.col("text")), stop=["common"]).first()) == (True, 0)


def test_projection_similarity_against_brute_force(spark, rows):
    rnd = random.Random(11)
    recs = {}
    for i in range(60):
        fields = set(rnd.sample([f"f{k}" for k in range(14)], rnd.randrange(6, 14)))
        recs[i] = fields
    for i in range(60, 75):
        recs[i] = set(recs[0]) | {"f0", "f1", "f2", "f3"}
    df = spark.createDataFrame([(i, sorted(f)) for i, f in recs.items()], "rec int, fields array<string>")
    want = []
    for a in recs:
        for b in recs:
            if a < b and len(recs[a]) >= 8 and len(recs[b]) >= 8:
                s = len(recs[a] & recs[b])
                j = s / len(recs[a] | recs[b])
                if j >= 0.8:
                    want.append((a, b, s, j))
    want.sort(key=lambda r: (-r[2], -r[3], r[0], r[1]))
    for top in (20, 50):
        got = [tuple(r) for r in sim.projection_similarity(df, top=top).collect()]
        assert got == want[:top]


def test_peer_pairs(spark, rows):
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    new = frame("ProductSubscription", "IOrderStore", "InvoiceHandler")
    old = frame("Subscription", "ProductSubscriptionPlan", "OrderStore", "PaymentHandler", "InvoiceHandler", "Unrelated")
    got = sim.peer_pairs(new, old)
    assert rows(got, "new_name", "rule", "peer_name", "peers") == [
        ("IOrderStore", "interface", "OrderStore", 1),
        ("IOrderStore", "stem", "OrderStore", 1),
        ("InvoiceHandler", "role", None, 1),
        ("ProductSubscription", "stem", "ProductSubscriptionPlan", 1),
        ("ProductSubscription", "stem", "Subscription", 1),
    ]
    assert rows(sim.role_members(old)) == [("Handler", "InvoiceHandler"), ("Handler", "PaymentHandler")]
