import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from subspan.functions.text import chunk_id, chunk_markdown, merge_short, sections, split_long
from subspan.sources import corpus, jobs
from subspan.streaming import jobs as worker

PARA = "word " * 100


def chunks(spark, text, **more):
    return [r["text"] for r in chunk_markdown(spark.createDataFrame([("d", text)], "doc string, text string"), "doc", "text", **more).orderBy("chunk_idx").collect()]


def one(spark, column, **values):
    names = list(values)
    kind = ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], kind).select(column.alias("x")).first()["x"]


def test_sections(spark):
    got = one(spark, sections("t"), t="# title\nintro\n## one\nbody ### no\n### two\n#### deep\n##nospace\n## \nlast")
    assert got == ["# title\nintro", "## one\nbody ### no", "### two\n#### deep\n##nospace", "## \nlast"]
    assert one(spark, sections("t"), t=" \n\n ") == []


def test_merging(spark):
    assert one(spark, merge_short("p"), p=["a" * 150, "b" * 100, "c" * 250, "d" * 10, "e" * 199]) == ["a" * 150 + "\n\n" + "b" * 100, "c" * 250 + "\n\n" + "d" * 10, "e" * 199]
    assert one(spark, merge_short("p"), p=[]) == []


def test_splitting(spark):
    paragraphs = [c * 400 for c in "abcdefghi"]
    got = one(spark, split_long("p"), p=["x", "\n\n".join(paragraphs), "y" * 3500])
    assert got == ["x", "\n\n".join(paragraphs[:7]), "\n\n".join(paragraphs[7:]), "y" * 3500]


def test_chunks_of_documents(spark):
    text = "# t\n\n" + "\n".join(f"## h{i}\n{PARA}" for i in range(3)) + "\n## tail\nshort"
    got = chunks(spark, text)
    assert len(got) == 5 or len(got) == 4
    assert "".join(got).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], "doc string, text string")
    assert [(r["chunk_id"], r["text"]) for r in chunk_markdown(docs, "doc", "text").collect()] == [("c_01", "x")]


def test_chunk_id_is_not_cut(spark):
    assert [one(spark, chunk_id("d", "n"), d="doc", n=n) for n in ("1", "12", "123")] == ["doc_01", "doc_12", "doc_123"]


def test_corpus_files(spark, tmp_path):
    entry = lambda i, v: {"id": f"c_{i}", "doc": "c", "chunk_idx": i, "text": "t", "embedding": v}
    (tmp_path / "a.json").write_text(json.dumps({"model": "m", "dimension": 2, "entries": [entry(1, [1, 0]), entry(2, [0, 1])]}, indent=1))
    got = corpus.read_embeddings(spark, str(tmp_path / "a.json")).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["id"], r["entity"], r["embedding"]) for r in got] == [(0, "c_1", "c", [1.0, 0.0]), (1, "c_2", "c", [0.0, 1.0])]
    (tmp_path / "b.json").write_text(json.dumps({"model": "m", "dimension": 3, "entries": [entry(1, [1, 0])]}))
    with pytest.raises(Exception, match="wrong dimension"):
        corpus.read_embeddings(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# hi\n\ntext")
    (tmp_path / "md" / "y.txt").write_text("no")
    assert [tuple(r) for r in corpus.read_markdown(spark, str(tmp_path / "md")).collect()] == [("x", "# hi\n\ntext")]
    corpus.write_embeddings(spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def request_of(kind, handle, **more):
    return {"job_id": kind, "mode": "query", "query": {"graph": handle, "query": {"type": kind} | more}}


def test_parsing_and_serialising(spark):
    good = json.dumps({"job_id": "1", "mode": "query", "extra": 1, "query": {"graph": "g", "query": {"type": "basins"}}})
    rows = jobs.parse_requests(spark.createDataFrame([(good,), ("not json",), ("{}",), ('{"job_id": 1',)], "value string")).collect()
    assert [r["error"] is None for r in rows] == [True, False, False, False]
    assert rows[0]["request"]["query"]["query"]["type"] == "basins" and rows[0]["request"]["build"] is None
    as_bytes = spark.createDataFrame([(good.encode(),)], "value binary")
    assert jobs.parse_requests(as_bytes).first()["error"] is None
    done = spark.createDataFrame([{"job_id": "1", "success": True, "worker_id": "w", "timestamp": "t"}], "job_id string, success boolean, error string, worker_id string, timestamp string")
    assert json.loads(jobs.serialize_results(done).first()[0]) == {"job_id": "1", "success": True, "worker_id": "w", "timestamp": "t"}


def test_worker(spark, tmp_path):
    rng = np.random.default_rng(42)
    entities = []
    for e in range(4):
        middle = rng.standard_normal(15)
        entities.append({"id": f"E{e}", "embeddings": (middle + 0.1 * rng.standard_normal((3, 15))).tolist()})
    config = {"k": 6, "p": 2, "k_graph": 2, "max_chunks": 3, "distance": "anything"}
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    n = [0]

    def send(*requests):
        for r in requests:
            n[0] += 1
            (inbox / f"{n[0]:03d}.json").write_text(r if isinstance(r, str) else json.dumps(r, indent=1))
        worker.run_worker(worker.request_stream(spark, str(inbox)), out, "w1").awaitTermination()
        return {r["job_id"]: r for r in jobs.read_results(spark.read.option("recursiveFileLookup", True).text(f"{out}/results")).collect()}

    bad = [dict(entities[0], embeddings=[]), entities[1]]
    got = send({"job_id": "b", "mode": "build", "build": {"entities": entities, "config": config}}, {"job_id": "e", "mode": "build", "build": {"entities": bad, "config": config}}, {"job_id": "n", "mode": "build"}, {"job_id": "x", "mode": "explode"}, "not json")
    assert got["b"]["success"] and (got["b"]["result"]["entities"], got["b"]["result"]["chunks"]) == (4, 12)
    assert got["e"]["error"].startswith("Computation failed: ") and got["n"]["error"] == "build mode requires build params"
    assert got["x"]["error"] == "Unknown mode: explode" and got["unknown"]["error"].startswith("Parse error")
    assert got["b"]["worker_id"] == "w1" and len(got["b"]["timestamp"]) == 24
    h = got["b"]["result"]["graph"]
    got = send(
        request_of("greedy_path", h, **{"from": "E0"}), request_of("reachable", h, **{"from": "E0", "depth": 2}), request_of("communities", h), request_of("basins", h), request_of("topology", h),
        dict(request_of("shortest_path", h, **{"from": "E0", "to": "E0"})), dict(request_of("greedy_path", h, **{"from": "E0", "to": "E2"}), job_id="to"), dict(request_of("greedy_path", h, **{"from": "Z"}), job_id="z"), request_of("nonsense", h),
    )
    path = got["greedy_path"]["result"]["path"]
    assert len(path["nodes"]) == 4 and len(path["distances"]) == 3 and path["total_distance"] == pytest.approx(sum(path["distances"]))
    assert got["to"]["result"]["path"]["nodes"] == ["E0", "E2"] and got["shortest_path"]["result"]["path"]["nodes"] == ["E0"]
    near = got["reachable"]["result"]["reachable"]
    assert [r["distance"] for r in near] == sorted(r["distance"] for r in near) and "E0" not in {r["id"] for r in near}
    t = got["topology"]["result"]["topology"]
    assert sum(x["in_degree"] for x in t["hub_centrality"]) == 8 and {m for c in t["communities"] for m in c["members"]} == {f"E{i}" for i in range(4)}
    assert got["communities"]["result"]["topology"]["basins"] == [] and got["basins"]["result"]["topology"]["communities"] == []
    assert "unknown entity" in got["z"]["error"] and "unknown query type: nonsense" in got["nonsense"]["error"]
    status = [r["status"] for r in spark.read.option("recursiveFileLookup", True).json(f"{out}/status").where("job_id = 'b'").orderBy(F.desc("status")).collect()]
    assert status == ["processing", "completed"] and spark.read.option("recursiveFileLookup", True).json(f"{out}/log").where("message = 'Building graph'").count() == 2


def test_program_builds_from_a_table(spark, tmp_path):
    from subspan.streaming.main import main

    rng = np.random.default_rng(43)
    spark.createDataFrame([(i, rng.standard_normal(8).tolist(), f"g{i % 4}") for i in range(40)], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/vectors")
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    config = {"k": 6, "p": 2, "k_graph": 2, "max_chunks": 3, "distance": "geodesic"}
    (inbox / "a.json").write_text(json.dumps({"job_id": "t", "mode": "build", "build": {"table": f"{tmp_path}/vectors", "entity": "label", "config": config}}))
    assert main([str(inbox)], {}, spark) == 2 and main([str(inbox), out], {}, spark) == 1
    assert main([str(inbox), out], {"JOB_ID": "7"}, spark) == 0
    read = lambda: jobs.read_results(spark.read.option("recursiveFileLookup", True).text(f"{out}/results")).collect()
    (got,) = read()
    assert got["success"] and (got["result"]["entities"], got["result"]["chunks"], got["worker_id"]) == (4, 40, "worker-7")
    import shutil

    shutil.rmtree(f"{out}/checkpoint")  # the batch is run again: its results are replaced, not repeated
    assert main([str(inbox), out], {"JOB_ID": "7"}, spark) == 0 and len(read()) == 1


def test_dimension_sweep(spark):
    from subspan.operators.ranking import dimension_sweep

    rng = np.random.default_rng(44)
    x = rng.standard_normal((60, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")

    def near(n):
        u = x[:, :n] / np.linalg.norm(x[:, :n], axis=1, keepdims=True)
        s = u @ u.T - 3 * np.eye(60)
        return [set(np.argsort(-row, kind="stable")[:5]) for row in s]

    want = {n: sum(len(a & b) for a, b in zip(near(n), near(12), strict=True)) / 300 for n in (3, 6, 12)}
    assert {r["dims"]: r["kept"] for r in dimension_sweep(frame, (3, 6, 12), 5).collect()} == pytest.approx(want)
