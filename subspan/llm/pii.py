"""Personal data: checked patterns, and spans added by weak supervision. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.common import durable, table, text_or_empty

#: The base patterns. Loops are possessive and starts guarded, so that no text makes them backtrack:
#: what follows a loop can never begin inside it, and a start inside a run fails as the run's start does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that the labelers vote on; numbers are the matches of the card pattern that are no card.
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"
#: Digit groups as on social security cards and in national telephone numbers.
GROUPED = "^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[- ][0-9]{3}[- ][0-9]{4})$"
#: A gazetteer of given names and places, and of words that announce personal data.
NAMES = "Alice Anna Antoine Carlos Claire David Elena Emma Hans Jean Juan John Julia Karl Laura Lucas Marie Maria Mary Michael Paul Peter Pierre Robert Sophie Thomas Berlin Lyon Madrid Paris Sevilla London Hamburg Bordeaux Boston Chicago".split()
CUES = "token|key|secret|passw|pwd|auth|bearer|card|karte|carte|tarjeta|account|konto|compte|cuenta|iban|phone|tel|call|mobil|ssn|passport|pass|id|name|nom|nombre|mr|mrs|dr|herr|frau|madame|monsieur"
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "secret": 4, "number": 5, "name": 6}
LABELERS = ("shape", "cue", "frame", "check", "sides")


def _running(sizes: Column, block: int = 256) -> Column:
    """Sums of all but the last of the first 1, 2, ... items: [0, s1, s1 + s2, ...], in time linear in their number."""

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))
    parts = F.transform(starts, lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    ahead = sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
    inner = F.zip_with(parts, F.slice(ahead, F.lit(1), F.size(parts)), lambda p, a: F.slice(sums(p, a), F.lit(1), F.size(p)))
    return F.when(F.size(sizes) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def find_all(rows: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """rows with the matches of pattern in the column text: an array (start, end, match) by code points."""
    gaps, found = f"_{name}_gaps", f"_{name}_found"
    rows = rows.withColumn(gaps, F.split(F.col(text), pattern, -1))
    rows = rows.withColumn(found, F.when(F.size(gaps) > 1, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    sizes = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(found)), F.col(found), lambda g, m: F.length(g) + F.length(m))
    rows = rows.withColumn(name + "_at", F.when(F.size(found) > 0, _running(sizes)).otherwise(F.array().cast("array<int>")))
    spans = F.transform(F.arrays_zip(F.col(found).alias("m"), F.slice(F.col(gaps), F.lit(1), F.size(found)).alias("g"), F.col(name + "_at").alias("a")), lambda x: F.struct((x["a"] + F.length(x["g"])).alias("start"), (x["a"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("match")))
    return rows.withColumn(name, F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))).drop(gaps, found, name + "_at")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _is_card(match: Column) -> Column:
    d = _digits(match)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)


def _is_ip(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _kept(spans: str, good) -> Column:
    return F.filter(spans, lambda s: good(s["match"]))


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """rows with an array column for each base kind, and number: digit groups of 7 to 19 digits that are no card."""
    for kind, pattern in BASE.items():
        rows = find_all(rows, text, pattern, kind)
    rows = rows.withColumn("number", F.filter("card", lambda s: F.length(_digits(s["match"])).between(7, 19) & ~_is_card(s["match"])))
    valid = {"ip": _is_ip, "card": _is_card, "phone": lambda m: F.length(_digits(m)).between(9, 15)}
    return rows.withColumns({kind: _kept(kind, good) for kind, good in valid.items()})


def _candidates(text: str) -> Column:
    """All candidates of a row with what stands around them."""
    before = lambda s: F.substring(F.col(text), F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    after = lambda s: F.substring(F.col(text), s["end"] + 1, F.lit(8))
    one = lambda kind: F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), before(s).alias("before"), after(s).alias("after")))
    return F.concat(one("secret"), one("number"), one("name"))


def _votes(spans: DataFrame) -> DataFrame:
    """spans with the labelers' votes: 1 for personal data, -1 against, 0 for none. They see the span and 24 characters around it, never the corpus."""
    m, kind = F.col("match"), F.col("kind")
    digits = F.length(_digits(m))
    shape = F.when(kind == "secret", F.when((F.length("match") >= 32) & m.rlike("^(?:[0-9a-f]+|[0-9A-F]+|[A-Za-z0-9+/]+)$"), 1).when(m.rlike("[-_/]"), -1).otherwise(0)).when(kind == "number", F.when(m.rlike(GROUPED), 1).when(digits < 9, -1).otherwise(0)).otherwise(0)
    cue = F.when(F.lower("before").rlike(rf"(?:^|[^\p{{L}}])(?:{CUES})[\p{{L}}]{{0,4}}[^\p{{L}}]{{0,6}}$"), 1).otherwise(0)
    frame = F.when(F.col("before").rlike(r"[=:]\s*[\"']?$"), 1).when(F.col("before").rlike(r"[\p{L}/.#v]$") | F.col("after").rlike(r"^[\p{L}/]"), -1).otherwise(0)
    check = F.when(kind == "number", F.when(digits >= 12, -1).otherwise(0)).when(kind == "secret", F.when(F.size(F.array_distinct(F.split("match", ""))) >= 11, 1).otherwise(-1)).otherwise(0)
    after = F.col("after")
    quoted = F.col("before").rlike("[\"'`]$") & after.rlike("^[\"'`]")
    sides = F.when(kind == "secret", F.when(quoted, 1).when(F.col("before").rlike(r"[/.:]$") & ~F.col("before").rlike(r"[=:]\s*$"), -1).otherwise(0)).when(kind == "number", F.when(after.rlike(r"^\s?(?:%|€|\$|£|km|kg|cm|mm|MB|GB|USD|EUR)"), -1).otherwise(0)).otherwise(F.when(after.rlike(r"^\s\p{Lu}\p{Ll}"), 1).otherwise(0))
    return spans.withColumns({"shape": shape, "cue": cue, "frame": frame, "check": check, "sides": sides})


def _features(spans: DataFrame) -> DataFrame:
    """spans with what the classifier sees: kind with length, share of digits, what stands on both sides, and whether a cue does."""
    sides = lambda c: F.when(c == "", "edge").when(c.rlike(r"^\p{L}"), "letter").when(c.rlike("^[0-9]"), "digit").when(c.rlike(r"^\s"), "space").otherwise("mark")
    share = F.length(_digits(F.col("match"))) / F.length("match")
    return spans.withColumns({
        "f_size": F.concat_ws(":", "kind", F.least(F.lit(6), F.floor(F.log2(F.length("match")))).cast("string")), "f_share": F.concat_ws(":", "kind", F.round(share * 4).cast("int").cast("string")),
        "f_left": F.concat_ws(":", "kind", sides(F.regexp_extract("before", r"(\S?)\s?$", 1))), "f_right": F.concat_ws(":", "kind", sides(F.substring("after", 1, 1))),
        "f_near": F.concat_ws(":", "kind", F.col("before").rlike(r"[=:]\s*[\"']?$").cast("string")), "f_cue": F.concat_ws(":", "kind", F.col("cue").cast("string")), "f_sides": F.concat_ws(":", "kind", F.col("sides").cast("string")),
    })


FEATURE_COLUMNS = ("f_size", "f_share", "f_left", "f_right", "f_near", "f_cue", "f_sides")


def fit_votes(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50, prior: float = 0.3) -> dict[tuple[int, ...], float]:
    """The chance of personal data for each vote pattern, by expectation-maximisation.

    A labeler votes given the truth, independent of the others, and its abstaining tells nothing. Its
    reliabilities are its vote frequencies in either class, to which a fifth of all its votes is
    added, right four times in five: what equal spans cannot tell follows the votes. Only shares
    count, so copies of a corpus give the same. The majority of votes begins. There are at most 3 to
    the number of labelers patterns, whatever the corpus.
    """
    belief = {p: min(0.95, max(0.05, prior + 0.25 * sum(p))) for p, _ in counts}
    total = sum(n for _, n in counts)
    for _ in range(rounds if counts else 0):
        prior = min(1 - 1e-6, max(1e-6, sum(n * belief[p] for p, n in counts) / total))
        logs = []
        for labeler in range(len(LABELERS)):
            added = 0.2 * sum(n for p, n in counts if p[labeler])
            seen = {v: [sum(n * (1 - belief[p]) for p, n in counts if p[labeler] == v) + added * (0.2 if v > 0 else 0.8), sum(n * belief[p] for p, n in counts if p[labeler] == v) + added * (0.8 if v > 0 else 0.2)] for v in (-1, 1)}
            sums = [seen[-1][z] + seen[1][z] for z in (0, 1)]
            logs.append({0: 0.0} | ({v: math.log(c[1] / sums[1]) - math.log(c[0] / sums[0]) for v, c in seen.items()} if added else {}))
        new = {}
        for p, _ in counts:
            x = math.log(prior / (1 - prior)) + sum(w[v] for w, v in zip(logs, p, strict=True))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        change = max((abs(new[p] - belief[p]) for p in new), default=0.0)
        belief = new
        if change < 1e-9:
            break
    return belief


def fit_classifier(rows: list[tuple[tuple[str, ...], tuple[int, ...], float]], belief: dict[tuple[int, ...], float]) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Bias of each kind and weights of each feature value: naive Bayes within kinds, on the beliefs as soft labels.

    Only shares count: a value's counts are smoothed by a hundredth of its kind's, in the proportion of the kind.
    """
    kind_of = lambda value: value.split(":")[0]
    sums: dict[str, list[float]] = {}
    seen: list[dict[str, list[float]]] = [{} for _ in FEATURE_COLUMNS]
    for values, votes, n in rows:
        b = belief[votes]
        for c in [sums.setdefault(kind_of(values[0]), [0.0, 0.0]), *[own.setdefault(v, [0.0, 0.0]) for own, v in zip(seen, values, strict=True)]]:
            c[1] += n * b
            c[0] += n * (1 - b)
    odds = {kind: math.log(c[1] / c[0]) for kind, c in sums.items()}
    smooth = lambda c, all_: math.log((c[1] + 0.01 * all_[1]) / (c[0] + 0.01 * all_[0]))
    weights = [{v: smooth(c, sums[kind_of(v)]) - odds[kind_of(v)] for v, c in own.items()} for own in seen]
    return odds, weights


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base (spans), spans.

    base and spans are arrays (start, ord, end, kind) by start, in code points, ends exclusive. base
    holds what the four patterns find and their checks keep; spans adds candidates (secrets, digit
    groups, listed names) that a classifier takes for personal data. It is trained on the votes of
    five labelers over all candidates of docs: regex shape, gazetteer cues to the left, framing,
    check sums and character variety, and the words and marks on both sides; expectation-maximisation
    weighs them. A labeler sees the candidate and its surroundings only, so its votes do not change
    with the size of the corpus. Only counts by vote pattern and feature value reach the driver; their number is bounded
    by the product of the values' numbers. Patterns are matched over whole texts, and no pattern
    can match a line feed.

    Null texts are empty and have no span. Documents with equal doc_id and text are one to the
    method, yet each row returns. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    rows = base_spans(rows, "text")
    rows = find_all(rows, "text", SECRET, "secret")
    rows = rows.withColumn("secret", F.filter("secret", lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")))
    rows = find_all(rows, "text", rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z])(?:{'|'.join(NAMES)})(?![\p{{L}}\p{{N}}])", "name")
    plain = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER[kind]).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    found = rows.select("doc_id", "th", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.array_sort(F.concat(*map(plain, BASE))).alias("base"), _candidates("text").alias("candidates"))
    found = durable(found)

    spans = found.where("size(candidates) > 0").select("doc_id", "th", "base", F.explode("candidates").alias("c")).select("doc_id", "th", "base", "c.*")
    inside = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    spans = spans.where(~inside).drop("base").distinct()
    spans = durable(_features(_votes(spans)).select("doc_id", "th", "kind", "start", "end", *LABELERS, *FEATURE_COLUMNS))
    counted = [(tuple(r[c] for c in FEATURE_COLUMNS), tuple(r[c] for c in LABELERS), float(r["count"])) for r in spans.groupBy(*LABELERS, *FEATURE_COLUMNS).count().orderBy(*LABELERS, *FEATURE_COLUMNS).collect()]
    patterns: dict[tuple[int, ...], float] = {}
    for _, votes, n in counted:
        patterns[votes] = patterns.get(votes, 0.0) + n
    odds, weights = fit_classifier(counted, fit_votes(sorted(patterns.items())))
    logit = F.lit(0.0)
    for column, own in [("kind", odds), *zip(FEATURE_COLUMNS, weights, strict=True)]:
        if own:
            logit = logit + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(own.items()) for x in kv]), F.col(column)), F.lit(0.0))
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("kind"))
    added = spans.where(logit > 0).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", kinds.alias("ord"), "end", "kind")).alias("added"))
    both = found.alias("f").join(added.alias("a"), F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.th") == F.col("a.th")), "left")
    return both.select("f.doc_id", *[f"n_{k}" for k in BASE], "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")))).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")  # noqa: E731  (a second parameter of the inner one would be the position)
    added = [count(kind).alias(f"n_{kind}") for kind in ("secret", "number", "name")]
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *added, F.size("spans").cast("long").alias("n_spans"))
