"""Toxicity: a learned lexicon trie met with Levenshtein automata, and scores by context window."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.common import Recent, durable, slices, table, text_or_empty

#: Insults known without labels, words that report speech, words of address.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "bastard")
REPORTS = frozenset("said says wrote quote quoted quotes called calls term word slur insult phrase reported alleged".split())
ADDRESS = frozenset("you your youre u ur".split())
QUOTES = frozenset("\"'“”‘’«»")
FOLD = str.maketrans("013457", "oieast")

WORDS = re.compile(r"\w+")
FEATURES = 7


class Trie:
    """Lexicon entries as nested dicts; "" holds (entry, whether longer words count too).

    Whole-word entries of at least `word` letters and stems of at least `stem` letters can be met
    misspelled; shorter ones have too many clean neighbours.
    """

    def __init__(self, entries: dict[str, bool], word: int = 5, stem: int = 6):
        self.root: dict = {}
        self.halves: set[tuple[int, str, str]] = set()
        self.sizes: dict[int, set[tuple[int, int]]] = {}
        beginnings: dict[int, set[str]] = {}  # halves of stems by place
        whole = [e for e, is_stem in entries.items() if not is_stem and len(e) > 3]
        self.swaps = {e[:i] + e[i + 1] + e[i] + e[i + 2 :] for e in whole for i in range(len(e) - 1)}  # two neighbouring letters exchanged
        for entry, is_stem in entries.items():
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = (entry, is_stem)
            cut = len(entry) // 2
            if is_stem and len(entry) >= stem:
                for at, half in ((0, entry[:cut]), (cut - 1, entry[cut:]), (cut, entry[cut:]), (cut + 1, entry[cut:])):
                    beginnings.setdefault(at, set()).add(half)
            elif not is_stem and len(entry) >= word:
                for n in (len(entry) - 1, len(entry), len(entry) + 1):
                    self.sizes.setdefault(n, set()).add((cut, len(entry) - cut))
                    self.halves |= {(n, entry[:cut], ""), (n, "", entry[cut:])}
        places = "|".join(f".{{{at}}}(?:{'|'.join(map(re.escape, sorted(own)))})" for at, own in sorted(beginnings.items()))
        self.beginning = re.compile(places, re.DOTALL).match if places else None
        self.word, self.stem = word, stem

    def may_be_near(self, word: str) -> bool:
        """Whether an entry that can be met misspelled can be one edit away: the edit leaves one of its halves as it was."""
        n = len(word)
        if any((n, word[:a], "") in self.halves or (n, "", word[-b:]) in self.halves for a, b in self.sizes.get(n, ())):
            return True
        return self.beginning is not None and self.beginning(word) is not None

    def exact(self, word: str) -> str | None:
        """The longest entry that is the word, or a stem that it begins with."""
        node, best = self.root, None
        for c in word:
            if "" in node and node[""][1]:
                best = node[""][0]
            node = node.get(c)
            if node is None:
                return best
        return node[""][0] if "" in node else best

    def near(self, word: str, most: int) -> str | None:
        """The entry with the fewest edits from the word, at most `most`; ties to the first by letters.

        Of a whole-word entry the edits from the word count, of a stem those from some beginning of
        the word. The word's Levenshtein automaton is run along the trie. Its state is, for each
        number of edits, the set of positions in the word as bits; a trie letter moves all of them
        at once. Entries too short to be met misspelled are met only as they are.
        """
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        full, end = (1 << (len(word) + 1)) - 1, 1 << len(word)
        start = tuple((1 << (e + 1)) - 1 & full for e in range(most + 1))
        best: tuple[int, str] | None = None
        stack = [(self.root, start)]
        while stack:
            node, state = stack.pop()
            if "" in node:
                entry, is_stem = node[""]
                stop = next((e for e, bits in enumerate(state) if bits & (full if is_stem else end)), None)
                if stop is not None and (not stop or len(entry) >= (self.stem if is_stem else self.word)):
                    best = min(best or (most + 1, ""), (stop, entry))
            for c, child in node.items():
                if not c:
                    continue
                hit, moved = letters.get(c, 0), []
                for e, bits in enumerate(state):
                    now = (bits & hit) << 1
                    if e:
                        now |= state[e - 1] | state[e - 1] << 1 | moved[-1] << 1
                    moved.append(now & full)
                if moved[-1]:
                    stack.append((child, tuple(moved)))
        return best[1] if best else None


@dataclass(frozen=True)
class Model:
    entries: dict[str, bool]
    weights: tuple[float, ...]  # of the features, then the bias
    scale: tuple[float, ...]


class Scorer(Recent):
    """Finds lexicon terms in texts. As a dict it tells 2 for a lexicon term, 1 for a misspelled one, else 0; a bounded cache."""

    def __init__(self, entries: dict[str, bool], room: int = 100_000):
        super().__init__(room)
        self.trie = Trie(entries)

    def make(self, word: str) -> int:
        low = word.lower()
        if not low.isalpha() and not low.isdigit():
            low = low.translate(FOLD)
        t = self.trie
        if t.exact(low):
            return 2
        return int(low in t.swaps or t.may_be_near(low) and t.near(low, 1) is not None)

    def features(self, text: str, window: int = 8) -> list[float]:
        """Exact and misspelled terms in abuse and in quotation, their share of the words, address nearby, and whether there is abuse.

        A term is quoted if an odd number of quotation marks of a kind stands before it in its line,
        or a word of report within the window before it.
        """
        words = WORDS.findall(text)
        hits = {w: kind for w in set(words) if (kind := self[w])}
        if not hits:
            return [0.0] * FEATURES
        found = [m for m in WORDS.finditer(text)]
        abuse, misspelt, quoted, quoted_misspelt, address, terms = 0, 0, 0, 0, 0, set()
        at, marks = 0, dict.fromkeys('"“”«»', 0)  # of the line, as far as the text was walked
        for i, m in enumerate(found):
            if m.group() not in hits:
                continue
            near = [x.group().lower() for x in found[max(0, i - window) : i + window + 1]]
            begin = text.rfind("\n", at, m.start()) + 1
            if begin:
                at, marks = begin, dict.fromkeys(marks, 0)
            for c in marks:
                marks[c] += text.count(c, at, m.start())
            at = m.start()
            in_marks = marks['"'] % 2 == 1 or marks["“"] > marks["”"] or marks["«"] > marks["»"]
            in_quotation = in_marks or not REPORTS.isdisjoint(near[: min(i, window)])
            exact = hits[m.group()] == 2
            if in_quotation:
                quoted, quoted_misspelt = quoted + exact, quoted_misspelt + (not exact)
            else:
                abuse, misspelt = abuse + exact, misspelt + (not exact)
                address += not ADDRESS.isdisjoint(near)
            if exact:
                terms.add(m.group().lower())
        return [math.log1p(abuse), math.log1p(misspelt), math.log1p(quoted) + 0.5 * math.log1p(quoted_misspelt), math.log1p(100 * abuse / len(words)), math.log1p(len(terms)), math.log1p(address), float(abuse > 0)]


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def learn_lexicon(sample: DataFrame, least: int = 5) -> dict[str, bool]:
    """Words and stems (word beginnings of 4 to 8 letters) that mark toxic texts in (text, toxic) rows.

    A term is taken if the share of toxic texts among those that hold it is at least 0.9 and is too
    high for chance among all terms seen: n * KL(share, base rate) over log(terms) + 4. A stem must
    say clearly more than any longer term it covers; terms that begin with a chosen stem are left
    out. Counting is distributed; the terms that return are bounded by the sample, of which each is
    in at least `least` toxic texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set()
                for w in {w.lower() for w in WORDS.findall(text)}:
                    own.add(w)
                    own.update(w[:k] + "*" for k in range(4, min(8, len(w)) + 1))
                for t in own:
                    counts.setdefault(t, [0, 0])[toxic] += 1
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = {}
        if counts:
            yield _counted(counts)

    def _counted(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "clean", "toxic"])

    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == n:
        return {}
    terms = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    base, total = bad / n, F.col("clean") + F.col("toxic")
    share = F.col("toxic") / total
    spread = F.when(F.col("clean") == 0, total * math.log(1 / base)).otherwise(total * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base))))
    terms = terms.where(f"toxic >= {least}").withColumn("gain", F.when(share >= 0.9, spread).otherwise(0.0))
    bound = math.log(max(1, terms.count())) + 4
    gain = {r["term"]: r["gain"] for r in terms.where(F.col("gain") > bound).collect()}
    narrower: dict[str, float] = {}  # the best gain among the terms that a stem covers, but for its own
    for term, g in gain.items():
        word = term.rstrip("*")
        for k in range(4, min(8, len(word)) + 1):
            if word[:k] + "*" != term:
                narrower[word[:k]] = max(g, narrower.get(word[:k], 0.0))
    entries: dict[str, bool] = {}
    for term in sorted(gain, key=lambda t: (-gain[t], -len(t), t)):
        word, stem = term.rstrip("*"), term.endswith("*")
        if word in entries or any(entries.get(word[:k]) for k in range(4, min(8, len(word)) + 1)):
            continue
        if not stem or gain[term] > 1.15 * narrower.get(word, 0.0):  # else the longer term says nearly as much and covers fewer clean words
            entries[word] = stem
    return entries


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Model:
    """Fit the lexicon and the classifier on at most max_labels labelled rows.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Of the others, those least by
    md5(doc_id) are the sample; a document with several labels counts as toxic if any is. Without
    labels of both kinds the known insults are used with fixed weights.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(max_labels)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = durable(rows)
    entries = {w: False for w in INSULTS} | learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(entries)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.float64())], ["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y double").groupBy("x", "y").count().toPandas()
    if got["y"].nunique() < 2:
        return Model(entries, (1.0, 0.5, -0.5, 0.3, 0.7, 0.3, 1.5, -2.5), (1.0,) * FEATURES)
    x, y, n = np.array(got["x"].tolist()), got["y"].to_numpy(), got["count"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the sum does not depend on the order of arrival
    x, y, n = x[order], y[order], n[order]
    scale = np.sqrt((n[:, None] * x**2).sum(0) / n.sum()) + 1e-6
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, ridge = np.zeros(FEATURES + 1), np.r_[np.full(FEATURES, 0.5), 1e-6]
    for _ in range(50):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge), z.T @ (n * (y - p)) - ridge * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Model(entries, tuple(w.tolist()), tuple(scale.tolist()))


def _scoring(model: Model):
    """A function from texts to their features and scores, with a cache of its own."""
    scorer, w, scale = Scorer(model.entries), np.array(model.weights), np.array(model.scale)

    def run(texts: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([scorer.features(t or "") for t in texts]).reshape(-1, FEATURES)
        return x, 1 / (1 + np.exp(-np.clip(x / scale @ w[:-1] + w[-1], -30, 30)))

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the terms' counts for each row, from its text alone.

    Null and empty texts score as texts without a term. A null doc_id is not held out. Repeated
    rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.entries, model.weights, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scoring(Model(*shared.value))
        for batch in slices(batches):
            x, s = scored(batch.column("text").to_pylist())
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s), pa.array((s >= threshold).astype("int32")), pa.array(np.expm1(x[:, 0]).round().astype("int64"))], [*names, "score", "predicted", "n_terms"])

    held = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held, text_or_empty().alias("text"), *carry)
    out = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", score double, predicted int, n_terms long"
    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.entries, model.weights, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scoring(Model(*shared.value))
        for batch in slices(batches):
            yield batch.filter(pa.array(scored(batch.column("text").to_pylist())[1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
