import random
import re

import numpy as np
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from subspan.llm.bpe import public_vocabulary, read_ranks
from subspan.llm.toxicity import Scorer, train
from tests.llm.fixtures import odd_texts
from tests.llm.test_near_and_toxic import closure, plain_dedup, plain_fingerprint
from tests.llm.test_order_and_shards import targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice(["ka", "ro", "mi", "te", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = odd_texts()
    for _ in range(40):
        texts.append("\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 6))))
    texts += texts[-5:] + [texts[-1] + "\n" + line(5), texts[-2].replace("a", "o", 1)]
    texts += [f"you idiot, {line(8)} you moron {line(3)} idiot" for _ in range(6)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts) if i % 2]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer, w, scale = Scorer(model.entries), np.array(model.weights), np.array(model.scale)
    toxic = lambda t: 1 / (1 + np.exp(-(np.array(scorer.features(t or "")) / scale @ w[:-1] + w[-1]))) >= 0.7
    path, pattern = public_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    rows = [(r[0], r[1], r[3]) for r in corpus()[0]]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "tokenize"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name == "toxicity":
            assert sum(toxic(t) for _, t, _ in rows) == 6
            rows = [r for r in rows if not toxic(r[1])]
        elif name == "line_dedup":
            texts, gone = plain_dedup([t for _, t, _ in rows])
            had = [sum(x.strip(" \t\x0b\x0c\r") != "" for x in (t or "").split("\n")) for _, t, _ in rows]
            lost = [sum(g[0] == i for g in gone) for i in range(len(rows))]
            rows = [(i, t, s) for (i, _, s), t, h, n in zip(rows, texts, had, lost) if h == 0 or n < h]
        elif name == "near_dedup":
            fp = {i: plain_fingerprint(t) for i, t, _ in rows}
            root = closure(fp, [(a, b) for a in fp for b in fp if b < a and (fp[a] ^ fp[b]).bit_count() <= 4])
            rows = [r for r in rows if root[r[0]] == r[0]]
        elif name == "source_mix":
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
            by = {}
            for i, _, s in rows:
                by[s] = by.get(s, 0) + size[i]
            taken, own = {}, {i: s for i, _, s in rows}
            full = {i: t for i, t, _ in rows}
            for r in got:
                n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
                assert full[r["doc_id"]].startswith(r["text"]) and r["source"] == own[r["doc_id"]]
                taken[own[r["doc_id"]]] = taken.get(own[r["doc_id"]], 0) + n
            assert all(abs(taken[s] - t) <= 1 for s, t in targets(by).items() if by[s])
            rows = [(r["doc_id"], r["text"], r["source"]) for r in got]
            continue
        else:
            assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(known.encode_ordinary(t))) for i, t, _ in rows)
            continue
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert sorted((r["doc_id"], r["text"] or "", r["source"] or "") for r in got) == sorted((i, t or "", s or "") for i, t, s in rows), name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_near_dedup_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(13)
    a, b, c, d, e = (" ".join(str(rng.randint(0, 9999)) for _ in range(400)) for _ in range(5))
    rows = [(2, a), (5, a), (5, b), (None, c), (None, d), (None, d), (None, b), (7, e), (7, e), (7, c), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(2, a), (5, b), (7, c), (0, d), (7, e), (9, "")])
    assert [r["text"] for r in got if r["doc_id"] == 9] == [None]


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 20


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
