import hashlib
import math
import re

from tests.llm.fixtures import documents, empty, odd_texts

from subspan.llm.pii import CUES, NAMES, find_personal_data, fit_classifier, fit_votes, joined, op1_pii_weak_labels
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    spans.sort()
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return [sum(s[2] == k for s in spans) for k in PATTERNS], listed


def outcome(df):
    return find_personal_data(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", joined("base").alias("b"), joined("spans").alias("s"), F.sha2(joined("base"), 256).alias("h")).collect()


def test_base_spans_of_odd_texts(spark):
    texts = odd_texts()
    got = outcome(documents(spark))
    assert len(got) == len(texts) + 1
    for r in got:
        counts, listed = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, texts[r["doc_id"]]
        assert r["b"] == listed
        assert r["h"] == hashlib.sha256(listed.encode()).hexdigest()
        assert {x for x in listed.split(",") if x} <= set(r["s"].split(","))


def test_many_matches_and_bad_runs(spark):
    texts = [" x ".join(f"1.2.3.{i % 300}" for i in range(3000)), "a." * 20000 + "@", "a@" + "b." * 20000, "+1" + " " * 20000, "1-" * 30000]
    for r in outcome(documents(spark, texts, repeat=False)):
        counts, listed = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["b"] == listed


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in outcome(docs):
        assert r["b"] == brute(texts[r["doc_id"]])[1]


def test_secrets_are_added_and_prose_is_not(spark):
    texts = [f'words here token = "{hashlib.sha1(bytes([i])).hexdigest()}" and more' for i in range(40)] + ["see internationalization-of-things/2 for more"] * 40
    got = {r["doc_id"]: r["s"] for r in outcome(documents(spark, texts, repeat=False))}
    assert all("secret:" in got[i] for i in range(40))
    assert not any(got[i] for i in range(40, 80))


def plain_candidates(text):
    """(kind, start, end) of secrets, digit groups and listed names outside the base spans."""
    base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in brute(text)[1].split(",") if x)]
    found = [("secret", m) for m in re.finditer(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    found += [("number", m) for m in re.finditer(PATTERNS["card"], text) if 7 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and not valid("card", m[0])]
    found += [("name", m) for m in re.finditer(rf"(?<!\w)(?:{'|'.join(NAMES)})(?!\w)", text)]
    return [(k, m.start(), m.end()) for k, m in found if not any(a < m.end() and m.start() < b for a, b in base)]


def plain_votes(text, kind, start, end):
    m, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    d = re.sub("[^0-9]", "", m)
    letter = r"[^\W\d_]"
    shape = check = sides = 0
    if kind == "secret":
        shape = 1 if len(m) >= 32 and re.search("^(?:[0-9a-f]+|[0-9A-F]+|[A-Za-z0-9+/]+)$", m) else -1 if re.search("[-_/]", m) else 0
        check = 1 if len(set(m)) >= 11 else -1
        sides = 1 if re.search("[\"'`]$", before) and re.search("^[\"'`]", after) else -1 if re.search("[/.:]$", before) else 0
    elif kind == "number":
        shape = 1 if re.search("^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[- ][0-9]{3}[- ][0-9]{4})$", m) else -1 if len(d) < 9 else 0
        check = -1 if len(d) >= 12 else 0  # those that pass are cards
        sides = -1 if re.search(r"^\s?(?:%|€|\$|£|km|kg|cm|mm|MB|GB|USD|EUR)", after) else 0
    elif re.search(rf"^\s{letter}", after) and after[1:3].istitle() and len(after) > 2:
        sides = 1
    cue = int(bool(re.search(rf"(?:^|(?!{letter}).)(?:{CUES}){letter}{{0,4}}(?:(?!{letter})[\s\S]){{0,6}}$", before.lower())))
    frame = 1 if re.search(r"[=:]\s*[\"']?$", before) else -1 if re.search(rf"(?:{letter}|[/.#v])$", before) or re.search(rf"^(?:{letter}|/)", after) else 0
    return shape, cue, frame, check, sides


def side(c):
    return "edge" if not c else "letter" if c.isalpha() else "digit" if c in "0123456789" else "space" if c in " \t\n\x0b\f\r" else "mark"


def plain_features(text, kind, start, end, votes):
    m, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    share = 4 * len(re.sub("[^0-9]", "", m)) / len(m)
    left = re.search(r"([^ \t\n\x0b\f\r]?)[ \t\n\x0b\f\r]?$", before)[1]
    near = str(bool(re.search(r"[=:]\s*[\"']?$", before))).lower()
    return tuple(f"{kind}:{x}" for x in (min(6, int(math.log2(len(m)))), int(math.floor(share + 0.5)), side(left), side(after[:1]), near, votes[1], votes[4]))


def test_added_spans_against_plain_version(spark):
    sha = lambda i: hashlib.sha1(bytes([i])).hexdigest()
    texts = [f'words here token = "{sha(i)}" and more' for i in range(30)] + ["see internationalization-of-things/2 for more"] * 20
    texts += [f"value {1000000 + i * 7} km, order 4111 1111 1111 11{i:02d} ssn 123-45-67{i:02d} by Mr. Karl Maier; Paris is far" for i in range(30)] + [f"call Anna: path/{sha(i)}.gz" for i in range(9)]
    rows = [(i, t, c) for i, t in enumerate(texts) for c in plain_candidates(t)]
    votes = [plain_votes(t, *c) for _, t, c in rows]
    features = [plain_features(t, *c, v) for (_, t, c), v in zip(rows, votes, strict=True)]
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0.0) + 1
    odds, weights = fit_classifier([(f, v, 1.0) for f, v in zip(features, votes, strict=True)], fit_votes(sorted(counts.items())))
    want = {i: set(brute(t)[1].split(",")) - {""} for i, t in enumerate(texts)}
    for (i, _, (kind, a, b)), f in zip(rows, features, strict=True):
        if odds[kind] + sum(w.get(x, 0.0) for w, x in zip(weights, f, strict=True)) > 0:
            want[i].add(f"{kind}:{a}:{b}")
    got = {r["doc_id"]: set(r["s"].split(",")) - {""} for r in outcome(documents(spark, texts, repeat=False))}
    assert got == want and any("name:" in x for w in want.values() for x in w) and any("secret:" in x for w in want.values() for x in w)


def test_spans_do_not_change_with_the_number_of_copies(spark):
    texts = ["Hello Mr. Maria row i said hi", f'token = "{hashlib.sha1(b"x").hexdigest()}" end', "number 1234567 units"]
    few, many = (outcome(documents(spark, texts * n, repeat=False)) for n in (3, 30))
    first = {r["doc_id"]: r["s"] for r in few}
    assert first[0] == "name:10:15" and first[1] == "secret:9:49" and first[2] == ""
    assert all(r["s"] == first[r["doc_id"] % 3] for r in [*few, *many])


def test_query_counts_the_spans_it_lists(spark, tmp_path):
    sha = hashlib.sha1(b"x").hexdigest()
    texts = ["Hello Mr. Maria row i said hi", f'token = "{sha}" end token = "{sha[::-1]}"', "ssn 123-45-6789 by Mr. Karl Maier, at a.b@c.de", "", None] * 6
    documents(spark, texts, repeat=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op1_pii_weak_labels(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(30))
    for r in rows:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone", "secret", "number", "name")] == [kinds.count(k) for k in ("email", "ip", "card", "phone", "secret", "number", "name")]
        assert r["n_spans"] == len(kinds) and r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]])[1].encode()).hexdigest()
    assert sum(r["n_secret"] for r in rows) == 12 and sum(r["n_name"] for r in rows) >= 6


def test_empty_table(spark):
    assert outcome(empty(spark)) == []


def test_reliabilities_follow_the_better_labeler():
    counts = [((1, 1, 0, 0, 0), 50.0), ((-1, -1, 0, 0, 0), 50.0), ((1, -1, 0, 0, 0), 2.0), ((0, 0, 0, 0, 0), 5.0)]
    belief = fit_votes(counts)
    assert belief[(1, 1, 0, 0, 0)] > 0.95 > 0.05 > belief[(-1, -1, 0, 0, 0)]
