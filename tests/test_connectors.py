"""Services over HTTP against a local stub, index builds, versioned collections, settings, and the forms beyond a broadcast."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone import models, saved
from lodestone.conf import Config, logger
from lodestone.operators import answers, chunking, dense, evaluation, lexical, rerank
from lodestone.operators.collections import Collections
from lodestone.plans import index
from lodestone.sources import readers, rest


class Stub(BaseHTTPRequestHandler):
    """Vectors of the texts' lengths, in reversed order; replies that name the prompt's last word. Every third request fails."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.seen.append((self.path, self.headers.get("Authorization"), body))
        if "fail" in self.path or len(Stub.seen) % 3 == 0:
            self.send_response(500)
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        if self.path.endswith("/embeddings"):
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            out = json.dumps({"data": data[::-1]})
        elif body["stream"]:
            content = body["messages"][0]["content"]
            out = "".join(f"data: {json.dumps({'choices': [{'delta': {'content': w + ' '}}]})}\n\n" for w in content.split()) + "data: {broken\n\n: note\n\ndata: {\"choices\": []}\n\ndata: [DONE]\n\ndata: late\n"
        else:
            content = body["messages"][0]["content"]
            out = json.dumps({"choices": [{"message": {"content": content.split()[-1] if isinstance(content, str) else content[1]["image_url"]["url"]}}]} if content != "empty" else {"choices": []})
        self.wfile.write(out.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest_services(spark, url, monkeypatch):
    monkeypatch.setenv("STUB_KEY", "k1")
    client = rest.RestEmbedder(url + "/", "m", "STUB_KEY", batch=2, attempts=3, wait=0.01)
    assert client.embed(["a", "bbb", "cc", None, "e" * 9]) == [[float(n), 1.0] for n in (1, 3, 2, 0, 9)]
    assert Stub.seen[0][1] == "Bearer k1" and all(len(b["input"]) <= 2 for p, _, b in Stub.seen if p == "/embeddings")
    df = models.with_embeddings(spark.createDataFrame([("four",), ("x",)], "text string"), lambda: rest.RestEmbedder(url, "m", attempts=4, wait=0.01))
    assert {r.text: list(r.embedding) for r in df.collect()} == {"four": [4.0, 1.0], "x": [1.0, 1.0]}
    chat = rest.RestChat(url, "m", attempts=3, wait=0.01, temperature=0.5, max_tokens=None)
    assert chat.complete(["say yes", None and ""][:1]) == ["yes"] and chat.reply("look", ["data:1"]) == "data:1"
    assert Stub.seen[-1][2]["temperature"] == 0.5 and "max_tokens" not in Stub.seen[-1][2]
    assert rest.RestChat(url, "m", streamed=True, attempts=3, wait=0.01).reply("one two three") == "one two three "
    with pytest.raises(rest.ServiceError):
        rest.RestChat(url, "m", attempts=2, wait=0.01).reply("empty")
    with pytest.raises(rest.ServiceError):
        rest.RestEmbedder(url + "/fail", "m", attempts=2, wait=0.01).embed(["a"])
    with pytest.raises(rest.ServiceError):
        rest.RestEmbedder("http://127.0.0.1:9", "m", attempts=1).embed(["a"])


def test_streamed_pieces():
    lines = [b'data: {"choices": [{"delta": {"content": "a"}}]}\n', b"\n", b"data: no json", b"", b": a comment", b"event: x", b'data: {"choices": [{"delta": {}}]}', b"\r\n", b'data: {"choices":', b'data:  [{"delta": {"content": "b"}}]}', b"", b"data: [DONE]", b"", b'data: {"choices": [{"delta": {"content": "c"}}]}', b""]
    assert list(rest.deltas(lines)) == ["a", "b"]
    assert list(rest.events([b"data: x", b"data:y", b"id: 1", b"", b"", b"data: last"])) == ["x\ny", "last"]


def test_failures_are_rows(spark):
    """One failing prompt in a batch: its error and nothing else changes; without a place for errors the job fails."""

    class Picky:
        tries: dict = {}

        def complete(self, prompts):
            if any(p.startswith("bad") for p in prompts):
                raise ValueError("no")
            for p in prompts:
                if p.startswith("slow") and Picky.tries.setdefault(p, 0) < 2:
                    Picky.tries[p] += 1
                    raise ValueError("later")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "slow"), (5, "b")], "query_id int, prompt string").coalesce(1)
    got = {r.query_id: (r.reply, r.error) for r in models.with_replies(df, Picky, error="error", seconds="s", attempts=3).collect()}
    assert got == {1: ("A", None), 2: (None, "no"), 3: (None, None), 4: ("SLOW", None), 5: ("B", None)}
    with pytest.raises(Exception, match="no"):
        models.with_replies(df, Picky).collect()
    assert models.with_replies(df.limit(0), Picky).collect() == []


def test_upserts_leave_other_buckets_alone(spark):
    store, name = Collections(spark, 8), "t_buckets"
    row = lambda i, text: (str(i), [float(i)], text, {"k": "v"}, 0)
    frame = lambda rows: spark.createDataFrame(rows, "id string, embedding array<float>, document string, metadata map<string,string>, at int")
    store.put(name, frame([row(i, "old") for i in range(60)]), "at")

    def found():
        at = store.location(name).removeprefix("file:")
        return {(p.parent.parent.name, p.name): p.stat().st_mtime_ns for p in Path(at).rglob("part-*.parquet")}

    before = found()
    store.put(name, frame([(*row(7, "first")[:4], 1), (*row(7, "second")[:4], 2), (None, [0.0], "x", {}, 1)]), "at")
    after = found()
    gone = set(before) - set(after)
    assert len({b for b, _ in gone}) == 1 and all(after[f] == t for f, t in before.items() if f not in gone)
    rows = {r.id: r.document for r in store.get(name).collect()}
    assert len(rows) == 60 and rows["7"] == "second" and rows["8"] == "old"
    # what a crashed writer left behind isn't read
    spark.sql(f"INSERT INTO {name}_data VALUES ('9', array(), 'ghost', map(), 3, 12345)")
    spark.catalog.refreshTable(name)
    store.remove(name, spark.createDataFrame([("7",), ("x",), (None,)], "id string"))
    rows = {r.id: r.document for r in store.get(name).collect()}
    assert len(rows) == 59 and "7" not in rows and "ghost" not in rows.values()
    assert {r.collection_name: r.document_count for r in store.status().collect()}[name] == 59
    store.replace(name, frame([row(1, "only")]))
    assert [r.document for r in store.get(name).collect()] == ["only"]
    store.put("t_empty", frame([]), "at")
    assert store.info("t_empty").first().document_count == 0
    assert store.delete(name) and store.delete("t_empty")


def test_language_model_reranks_end_to_end(spark):
    class Reverse:
        def complete(self, prompts):
            return [",".join(reversed([w[1:-1] for w in p.split() if w.startswith("[") and w.endswith("]")])) for p in prompts]

    rows = [(q, f"question {q}", i, f"text {i}", 1.0 - i / 10, i) for q in (1, 2) for i in range(1, 4)]
    hits = spark.createDataFrame(rows, "query_id int, query string, doc_id int, content string, score double, rank int")
    got = {(r.query_id, r.doc_id): r.new_rank for r in rerank.rerank(hits, "llm", make=Reverse).collect()}
    assert got == {(q, i): 4 - i for q in (1, 2) for i in range(1, 4)}


def test_index_build_and_versions(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# One\ntext\n## Two\nmore\n")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"1")
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in ({"image_path": "a.png", "caption": "old", "source": "s"}, {"image_path": "a.png", "caption": "new"}, {"image_path": "gone.png", "caption": "c"}, {"image_path": "a.png", "caption": ""})))
    make = lambda: models.embedder("hash")
    names = {"documents": "t_docs", "images": "t_images"}
    store = Collections(spark)
    for rebuild in (True, False, True):
        got = index.build_all(spark, str(tmp_path / "md"), str(tmp_path / "r.jsonl"), str(tmp_path / "img"), make, make, **names, rebuild=rebuild)
        assert {r.collection_name: r.document_count for r in got.collect()} == {"t_docs": 2, "t_images": 1}
    row = store.get("t_images").first()
    assert row.document == "new" and row.metadata["image_path"] == "a.png" and len(row.embedding) == 64
    two = store.get("t_docs").where("document like '## Two%'").first()
    assert two.metadata["header_path"] == "One/Two" and "prev_id" in two.metadata and "next_id" not in two.metadata
    # what a crashed run leaves behind is no obstacle, and the metric stays
    spark.sql("CREATE TABLE t_docs_v4 (x int) USING parquet")
    (tmp_path / "md" / "x.md").write_text("# One\nother\n")
    assert index.build_documents(spark, str(tmp_path / "md"), "t_docs", make, rebuild=True).first().document_count == 1
    assert store.metric("t_docs") == "cosine" and store.delete("t_docs") and not store.delete("t_docs") and store.delete("t_images")
    with pytest.raises(ValueError):
        store.info("t_docs")


def test_sections_keep_every_character(spark):
    text = "a\u0001b\n# H\u0001 1\n```\n# no\n## no\n```\nmore\n#hash\n```open\n# in\n"
    rows = chunking.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_path int, text string")).orderBy("pos").collect()
    assert [r.text for r in rows] == ["a\u0001b", text[4:].rstrip()] and list(rows[1].header_path) == ["H\u0001 1"]


def test_settings_and_log(tmp_path):
    (tmp_path / "c.json").write_text('{"top_k": 3}')
    assert Config.load(str(tmp_path / "c.json")) == Config(top_k=3)
    (tmp_path / "d.json").write_text('{"topk": 3}')
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "d.json"))
    log = logger("lodestone.test", str(tmp_path / "x.log"))
    log.info("hello")
    assert logger("lodestone.test") is log and "hello" in (tmp_path / "x.log").read_text()


def test_search_fills_up_with_unmatched_documents(spark):
    """Fewer hits than k, negative weights, and no hit at all: as if all documents were ranked."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "alpha", "alpha gamma", "delta", "", None, "beta beta"])], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "none"), (4, "")], "query_id bigint, query string")
    for k in (1, 3, 9):
        full = lexical.bm25_scores(lexical.build_index(docs, only_terms=lexical.question_terms(asked)), asked).collect()
        want = sorted((q, r + 1, d) for q in (1, 2, 3, 4) for r, (_, d) in enumerate(sorted((-round(x.score, 6), x.doc_id) for x in full if x.query_id == q)[:k]))
        assert sorted((r.query_id, r.rank, r.doc_id) for r in lexical.bm25_search(docs, asked, k).collect()) == want
    assert {(r.term, r.df): round(r.idf, 9) for r in lexical.term_statistics(docs).collect()} == {(r.term, r.df): round(r.idf, 9) for r in lexical.build_index(docs).terms.collect()}


def test_forms_beyond_a_broadcast(spark, monkeypatch):
    rows, asked = spark.range(50).toDF("a"), spark.range(30).toDF("b")
    assert saved.against_all(rows, asked, blocks=4, most=5).distinct().count() == 1500 == saved.against_all(rows, asked).count()
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(40)], "vec_id bigint, embedding array<double>")
    q = vectors.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    want = sorted(map(tuple, dense.dense_search(vectors, q, 3).collect()))
    monkeypatch.setattr(dense, "MOST_BYTES", 50)
    assert sorted(map(tuple, dense.dense_search(vectors, q, 3).collect())) == want and len(want) == 30
    assert dense.dense_search(vectors, q.limit(0), 3).collect() == []


def test_long_lists_are_packed_as_if_whole(spark):
    rows = spark.createDataFrame([(k, i, "x" * (i % 3 + k)) for k in (1, 2) for i in range(400)] + [(3, 1, " ")], "query_id int, rank int, content string")
    for r in answers.pack_context(rows, 300).collect():
        parts = ["x" * (i % 3 + r.query_id) for i in range(400)] if r.query_id < 3 else []
        taken, used = [], 0
        for p in parts:
            if used + len(p) > 300:
                break
            taken.append(p)
            used += len(p) + 2
        assert r.context == "\n\n".join(taken) and r.parts == len(taken)


def test_first_ranks(spark):
    rows = spark.createDataFrame([(1, 5, 0.9, False), (1, 6, 0.8, True), (1, 7, 0.95, False), (2, 5, 0.5, False), (3, 4, 0.5, True), (3, 3, 0.5, False)], "query_id int, id int, score double, relevant boolean")
    assert {r.query_id: r.rank for r in evaluation.first_ranks(rows).collect()} == {1: 3, 2: None, 3: 2}


def test_evaluation_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "m", 0.5), ("a", "n", 1.0), ("b", "m", None)], "id string, metric string, score double")
    readers.save_report(rows, str(tmp_path / "r"))
    assert sorted((r.id, r.metrics.asDict()) for r in spark.read.json(str(tmp_path / "r" / "query_results")).collect())[0] == ("a", {"m": 0.5, "n": 1.0})
    assert {r.metric: (r.average, r["count"]) for r in spark.read.json(str(tmp_path / "r" / "summary")).collect()} == {"m": (0.5, 1), "n": (1.0, 1)}


def test_many_headings_take_linear_time(spark):
    import time

    spent = []
    for n in (2000, 16_000):
        text = "".join(f"{'#' * (1 + i % 6)} head {i}\nbody\n" for i in range(n))
        d = spark.createDataFrame([(1, text)], "doc_path int, text string")
        began = time.time()
        rows = chunking.sections(d)
        assert rows.count() == n and rows.where(f"pos = {n - 1}").first().prev_id is not None
        spent.append(time.time() - began)
    assert spent[1] < 3 + 12 * spent[0]
