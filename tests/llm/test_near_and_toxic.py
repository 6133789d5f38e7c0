import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subspan.llm.ann import cosine, encode, estimate, rotation, search, usable
from subspan.llm.linededup import _sieved, dedup_lines, near_links, probes
from subspan.llm.simhash import fingerprint, links, near_duplicates, posting_sets, shingle_hashes, spanning_links
from subspan.llm.toxicity import Scorer, Trie, keep_clean, score, train
from subspan.plans.lineage import durable
from tests.llm.fixtures import documents, empty, odd_texts


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in odd_texts():
        assert fingerprint(t or "") == plain_fingerprint(t)
    assert len(shingle_hashes("a b c")) == 1 and len(shingle_hashes("a b c d e")) == 2


def test_posting_sets_cover():
    from itertools import combinations

    sets = posting_sets()
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))


def near_values(rng, centres=30, copies=12):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(copies):
            v = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            out.add(v)
    return sorted(out | {0, 1, 7, (1 << 64) - 1})


@pytest.mark.parametrize("block, large", [(4096, 64), (4, 2)])
def test_links_join_what_all_pairs_join(spark, block, large):
    values = near_values(random.Random(1))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [(r["u"], r["v"]) for r in links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=block, large=large).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in got)
    want = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert closure(signed, got) == closure(signed, want)


def test_spanning_links_are_few():
    rng = random.Random(2)
    c = rng.getrandbits(64)
    tight = np.array(sorted({c ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}), np.uint64)
    assert len(spanning_links(tight)) == len(tight) - 1


def test_components_of_documents(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(600))
    texts = odd_texts() + [base, base.upper(), base + " one", base.replace("alpha1", "beta", 1)] + [base] * 30
    docs = documents(spark, texts)
    got = near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    fps = [plain_fingerprint(t) for t in texts]
    want = closure(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all((r["fp"] & ((1 << 64) - 1)) == fps[r["doc_id"]] for r in got)
    assert near_duplicates(empty(spark)).collect() == []


# ---------------------------------------------------------------- line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line) or 1)
        line = rng.choice([line[:i] + line[i + 1 :], line[:i] + "#" + line[i:], line[:i] + "%" + line[i + 1 :]])
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_probes_miss_no_pair(edits):
    rng = random.Random(edits)
    for _ in range(400):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(24, 40)))
        b = edited(rng, a, rng.randint(0, edits))
        if edit_distance(a, b) > edits:
            continue
        a, b = sorted((a, b), key=len)
        cut = lambda k, n=len(a): n * k // (edits + 1)
        assert any(d == len(b) - len(a) and b[max(0, cut(k) + s) : max(0, cut(k + 1) + s)] == a[cut(k) : cut(k + 1)] for d, k, s in probes(edits))


def allowed_edits(a, b):
    n = min(len(a), len(b))
    return 0 if n < 12 else 1 if n < 24 else 2


def linked_lines(spark, lines, **more):
    """What near_links and all pairs join, as closures."""
    frame = spark.createDataFrame([(x,) for x in lines + lines[:5]], "line string").select(F.unhex(F.md5("line")).alias("h"), "line")
    name = {bytes(r["h"]): r["line"] for r in frame.collect()}
    got = [(name[bytes(r["u"])], name[bytes(r["v"])]) for r in near_links(frame, **more).collect()]
    assert all(a != b and edit_distance(a, b) <= allowed_edits(a, b) for a, b in got)
    want = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= allowed_edits(a, b)]
    assert want
    return closure(lines, got), closure(lines, want)


@pytest.mark.parametrize("hot, few, levels", [(256, 1000, 4), (3, 0, 3), (2, 0, 0)])
def test_line_links_join_what_all_pairs_join(spark, hot, few, levels):
    rng = random.Random(5)
    lines = set()
    for i in range(12):
        a = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(12, 60) if i else 230)).strip().ljust(12, "z")
        lines |= {edited(rng, a, rng.randint(0, 3)) for _ in range(9)} | {a}
    lines = sorted(x for x in lines if len(x) >= 12)
    got, want = linked_lines(spark, lines, hot=hot, broadcast_keys=few, levels=levels)
    assert got == want


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_few_rows_pass_the_sieve_besides_those_of_its_keys(spark, most):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), F.col("id").alias("text"))
    keys = rows.where("text < 1000").select("key")
    left = _sieved(rows, keys, 1000, most)
    assert left.columns == rows.columns and left.where("text < 1000").count() == 1000
    assert left.count() < 1000 + 199_000 * 0.005
    assert _sieved(rows, keys.limit(0), 0).count() == 0


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    before = files()
    found = durable(spark.range(50_000).groupBy((F.col("id") % 7000).alias("k")).agg(F.max("id").alias("m")))
    until = time.time() + 20
    while files() - before and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert not files() - before
    assert found.count() == 7000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_line_links_of_one_template(spark):
    rng = random.Random(15)
    lines = {f"GET /a/common/beginning/of/lines?id={rng.randint(0, 10**4):04d}&x={rng.choice('abcdef')} HTTP" for _ in range(120)}
    lines |= {f"{rng.randint(0, 99):02d} the same text stands in the middle of it {rng.randint(0, 99):02d}" for _ in range(60)}
    got, want = linked_lines(spark, sorted(lines), hot=8)
    assert got == want


def test_line_links_of_many_near_lines(spark):
    rng = random.Random(35)
    base = "".join(rng.choice("abcdefgh ") for _ in range(48))
    lines = {edited(rng, base, 1) for _ in range(90)} | {edited(rng, base, 3) for _ in range(30)} | {base[:20] + str(i) * 5 + base[25:] for i in range(10)}
    got, want = linked_lines(spark, sorted(lines), hot=16)
    assert got == want


def test_a_common_beginning_is_not_compared_in_pairs(spark):
    import time

    rng = random.Random(25)
    lines = ["https://example.com/a/common/beginning/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) for _ in range(20_000)]
    near = [edited(rng, x[39:], 1) for x in lines[:50]]
    frame = spark.createDataFrame([(x,) for x in lines + [x[:39] + y for x, y in zip(lines, near, strict=False)]], "line string").select(F.unhex(F.md5("line")).alias("h"), "line")
    began = time.time()
    assert near_links(frame).count() == 50
    assert time.time() - began < 120


def plain_dedup(texts):
    spots = [(i, n, x.strip(" \t\x0b\x0c\r")) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    lines = sorted({x for _, _, x in spots if x})
    long = [x for x in lines if len(x) >= 12]
    of = closure(lines, [(a, b) for i, a in enumerate(long) for b in long[:i] if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= allowed_edits(a, b)])
    seen, gone = set(), set()
    for i, n, x in spots:
        if x:
            gone |= {(i, n)} if of[x] in seen else set()
            seen.add(of[x])
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)], gone


def test_dedup_of_documents(spark):
    texts = odd_texts() + ["many\n" * 300 + "end of the many lines here now", "a long enough repeated line of text!\n" * 50]
    want, gone = plain_dedup(texts)
    docs = documents(spark, texts, repeat=False)
    out = dedup_lines(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and set(docs.columns) <= set(out.columns)
    for i in range(len(texts)):
        assert got[i]["text"] == want[i], i
        assert got[i]["_n_dropped"] == sum(g[0] == i for g in gone)
    twice = dedup_lines(documents(spark, texts[:3])).collect()
    assert len(twice) == 4 and dedup_lines(empty(spark)).collect() == []


# ---------------------------------------------------------------- nearest neighbours


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if a is None else float(a) for a in v], 1, "code") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, code string")


def brute(ids, x, queries, k=5):
    out = {}
    for q in queries:
        s = [(-float(cosine(x[q][None], x[i][None])[0]), i) for i in ids if i != q]
        out[q] = [i for _, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_search_against_brute_force(spark, block):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 64))
    x[100:160] = x[50]  # many equal vectors: ties to the smaller id
    x[300] = x[0] * 3
    v = usable(vectors(spark, x))
    got = {}
    for r in search(v, v.where("id % 50 = 0"), block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(range(700), x, range(0, 700, 50))
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.97 * 5 * len(want) and [i for _, i, _ in sorted(got[50])] == list(range(100, 105))
    assert all(s == float(cosine(x[q][None], x[i][None])[0]) for q in got for _, i, s in got[q])


def test_search_edges(spark):
    bad = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 1, 1, 1], [1.0, 2.0], [1, 0, 0, 0], [0, 1, 0, 0], [1e200, 1e200, 0, 0]]
    v = usable(vectors(spark, bad).union(spark.createDataFrame([(None, [1.0, 0.0, 0.0, 0.0], 1, "c")], vectors(spark, bad).schema)))
    assert sorted(r["id"] for r in v.collect()) == [6, 7, 8, 9]
    got = search(v, v).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(7, 9), (7, 8), (8, 9), (8, 7), (9, 7), (9, 8)]
    assert got[0]["score"] == pytest.approx(0.5**0.5)
    assert search(v.where("false"), v.where("false")).collect() == [] and search(v, v.where("false")).collect() == []


def test_search_counts_repeated_rows(spark):
    x = np.eye(6)
    v = usable(vectors(spark, list(x))).union(usable(vectors(spark, list(x))).where("id = 3"))
    got = search(v, v.where("id = 0"), k=7).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5)]


def test_search_meets_each_length(spark):
    rng = np.random.default_rng(12)
    x = [rng.standard_normal(8 if i % 3 else 5) for i in range(60)]
    got = {}
    v = usable(vectors(spark, x))
    for r in search(v, v, bound=9.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for n in (5, 8):
        ids = [i for i in range(60) if len(x[i]) == n]
        assert {q: got.get(q) for q in ids} == brute(ids, x, ids)


def test_error_bound_holds():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    turn = rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, align = encode(x, turn)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    est, slack = estimate(codes, align, unit(q) @ turn, 2.5)
    off = np.abs(est - unit(x) @ unit(q).T) > slack[:, None]
    assert codes.shape == (2000, 8) and off.mean() < 0.03


# ---------------------------------------------------------------- toxicity


def test_automaton_against_edit_distance():
    rng = random.Random(8)
    entries = ["idiot", "moron", "scum", "stupid", "pathetic", "naïve"]
    trie = Trie(dict.fromkeys(entries, False), word=1)
    for _ in range(600):
        w = edited(rng, rng.choice(entries), rng.randint(0, 3)) if rng.random() < 0.8 else "".join(rng.choice("idotmrnscu") for _ in range(rng.randint(1, 8)))
        for most in (0, 1, 2):
            best = min((edit_distance(w, e), e) for e in entries)
            assert trie.near(w, most) == (best[1] if best[0] <= most else None), (w, most)


def test_automaton_meets_stems():
    rng = random.Random(11)
    entries = {"worthle": True, "disgus": True, "idiot": False, "low": True}
    trie = Trie(entries)
    for _ in range(600):
        w = edited(rng, rng.choice(list(entries)) + rng.choice(["", "ss", "ting"]), rng.randint(0, 2))
        ways = [(edit_distance(w, "idiot"), "idiot"), *[(min(edit_distance(w[:i], e) for i in range(len(w) + 1)), e) for e, stem in entries.items() if stem]]
        best = min((x for x in ways if not x[0] or len(x[1]) >= (6 if entries[x[1]] else 5)))
        assert trie.near(w, 1) == (best[1] if best[0] <= 1 else None), w
        assert trie.near(w, 1) in (None, "low") or trie.may_be_near(w) or trie.exact(w), w


def test_stems_and_quotation():
    s = Scorer({"idiot": False, "lowe": True, "scum": False, "disgus": True})
    words = ("idiot", "IDIOT", "id1ot", "idiots", "idoit", "lowest", "low", "slowe", "ideal", "scum", "scmu", "scam", "dsgusting", "disqusted", "x" * 90)
    assert [s[w] for w in words] == [2, 2, 2, 1, 1, 2, 0, 0, 0, 2, 1, 0, 1, 1, 0]
    assert s["disgust" + "x" * 900] == 2 and s["disqust" + "x" * 900] == 1  # words of any length
    abuse, quoted, said = (s.features(t) for t in ("you are an idiot here", 'the text has "an idiot" in it', "he called them an idiot there"))
    assert abuse[0] > 0 and abuse[5] > 0 and quoted[0] == said[0] == 0 and quoted[2] > 0 and said[2] > 0
    assert s.features("") == [0.0] * 7 and s.features("clean words only") == [0.0] * 7
    few = Scorer({"idiot": False}, room=3)
    assert few.features("a b c d e f g h idiot i j k") == Scorer({"idiot": False}).features("a b c d e f g h idiot i j k") and len(few) + len(few.older) <= 6


def test_marks_are_counted_over_the_whole_line():
    s, far = Scorer({"idiot": False}), "clean " * 100
    quoted = s.features(f'the text has "{far} an idiot" in it')
    abuse = s.features(f'"{far}" and "more" you idiot')
    assert quoted[0] == 0 and quoted[2] > 0 and abuse[0] > 0 and abuse[2] == 0
    lines = s.features(f'"{far} idiot\nan idiot “{far} idiot')  # the second line begins without marks
    assert lines[0] == pytest.approx(np.log(2)) and lines[2] == pytest.approx(np.log(3))


def corpus(spark, n=1500):
    rng = random.Random(9)
    words = ["".join(rng.choice(["ba", "lo", "ti", "re", "mu", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["idiot", "xqu" + rng.choice(words), "xqu" + rng.choice(words)]))
        rows.append((i, " ".join(t), "z", "z", 1))
        labels.append((i, 1, int(toxic), "extra"))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, toxic string, held_out long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels)
    assert "xqu" in " ".join(model.entries)
    got = score(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    import zlib

    assert {r["doc_id"] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held) >= 0.97 * len(held)
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got)
    clean = keep_clean(docs, model)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    again = train(docs.repartition(5), labels.repartition(3))
    assert again.entries == model.entries and again.weights == pytest.approx(model.weights)


def test_toxicity_edges(spark):
    docs, labels = corpus(spark, 60)
    for l in (labels.where("false"), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = train(docs, l)
        got = {r["doc_id"]: r["predicted"] for r in score(documents(spark), model).collect()}
        assert set(got) == set(range(len(odd_texts()))) and not any(got.values())
    bad = score(spark.createDataFrame([(1, "you idiot moron scum, you idiot")], "doc_id long, text string"), model).first()
    assert bad["predicted"] == 1
    assert score(empty(spark), model).collect() == []
