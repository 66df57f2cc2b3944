import hashlib
import http.server
import json
import pathlib
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.sources import remote, statements


@pytest.fixture(scope="module")
def server():
    asked = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            moved = {"/moved": "/page.html", "/loop": "/loop", "/away": "file:///etc/hostname", "/ftp": "ftp://127.0.0.1/x"}.get(self.path)
            code = 302 if moved else 404 if self.path == "/none" else 503 if self.path == "/down" or (self.path == "/late" and asked["/late"] < 3) else 200
            body = b"" if code != 200 else b"<p>late</p>" if self.path == "/late" else b"%PDF-1.7 " + b"x" * 5000 if self.path == "/long" else b"<h1>T</h1>"
            self.send_response(code)
            if moved:
                self.send_header("Location", moved)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    held = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}", asked
    held.shutdown()


def test_addresses_of_a_table(spark, server):
    base, asked = server
    asked.clear()
    urls = [f"{base}/{x}" for x in ("page.html", "page.html", "moved", "loop", "away", "ftp", "none", "down", "late", "long")] + ["file:///etc/hostname", "http://127.0.0.1:1/", "", None]
    table = spark.createDataFrame([(u, 1) for u in urls], "`an url` string, url int")
    rows = {r.url: r for r in remote.fetch(table, "an url", tries=3, pause=0.01, max_bytes=4000).collect()}
    assert set(rows) == set(urls) and asked["/page.html"] == 2 and asked["/down"] == asked["/late"] == 3 and asked["/none"] == 1
    assert bytes(rows[f"{base}/moved"].content) == b"<h1>T</h1>" and rows[f"{base}/moved"].final_url == f"{base}/page.html"
    assert bytes(rows[f"{base}/late"].content) == b"<p>late</p>" and rows[f"{base}/late"].status == 200
    assert {u: rows[u].status for u in rows if rows[u].content is None} == {f"{base}/loop": 302, f"{base}/away": 302, f"{base}/ftp": 302, f"{base}/none": 404, f"{base}/down": 503, f"{base}/long": 200, "file:///etc/hostname": None, "http://127.0.0.1:1/": None, "": None, None: None}
    assert all((r.content is None) == (r.error is not None) for r in rows.values())
    assert remote.fetch(table.limit(0), "an url").count() == 0


def test_documents_of_a_list(spark, server):
    base, _ = server
    spark.dataSource.register(remote.UrlSource)
    listed = "\n".join([f"{base}/page.html", "", f"{base}/long", f"{base}/none", f"{base}/page.html"])
    got = spark.read.format("web_documents").option("urls", listed).option("per_task", "1").load()
    assert got.rdd.getNumPartitions() == 3
    docs = {r.source_file: r for r in remote.as_documents(got).collect()}
    assert {u.removeprefix(base): r.format for u, r in docs.items()} == {"/page.html": "html", "/long": "pdf"}
    assert docs[f"{base}/page.html"].doc_id == hashlib.sha256(b"<h1>T</h1>").hexdigest()
    assert spark.read.format("web_documents").load().count() == 0


def _graph(spark, n=250):
    nodes = [("d", f"n{i}", f"N {i}", "entity") for i in range(n)] + [("d", "n1", "N 1", "entity"), ("e", "q", None, "a`b"), ("e", "z", "Z", None), ("e", None, "gone", "entity")]
    edges = [("d", f"n{i}", f"n{i + 1}", "works at-home") for i in range(n - 1)] + [("d", "q", "z", None), ("d", "q", None, "x")]
    return spark.createDataFrame(nodes, "doc_id string, id string, label string, type string"), spark.createDataFrame(edges, "doc_id string, source string, target string, relation string")


def test_statements_round_trip(spark, tmp_path):
    nodes, edges = _graph(spark)
    uri = f"file://{tmp_path}/out"
    assert statements.statements(spark, uri).count() == 0
    statements.export(nodes, edges, uri, rows=50)
    held = statements.statements(spark, uri).collect()
    merged = {(r.statement, json.dumps(row, sort_keys=True)) for r in held for row in r.rows}
    by_statement = Counter(r.statement for r in held for _ in r.rows)
    assert sum(by_statement.values()) == len(merged)
    node, edge = "UNWIND $rows AS r MERGE (n:`{}` {{id: r.id}}) SET n.name = r.name, n.doc_id = r.doc_id", "UNWIND $rows AS r MATCH (a {{id: r.source}}), (b {{id: r.target}}) MERGE (a)-[:`{}`]->(b)"
    assert by_statement == {node.format("entity"): 250, node.format("a``b"): 1, node.format("Entity"): 1, edge.format("WORKS_AT_HOME"): 249, edge.format("RELATED_TO"): 1}
    assert max(len(r.rows) for r in held) < 100 and (node.format("a``b"), json.dumps({"doc_id": "e", "id": "q", "name": "q"})) in merged
    statements.export(nodes, edges, uri, rows=50)
    assert statements.statements(spark, uri).count() == 2 * len(held)
    statements.export(nodes.limit(0), edges.limit(1), uri, mode="overwrite")
    assert [(r.stage, len(r.rows)) for r in statements.statements(spark, uri).collect()] == [("edges", 1)]
    assert not [p for p in pathlib.Path(tmp_path, "out").iterdir() if "pending" in p.name]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(statements.StatementSink)
    uri = f"file://{tmp_path}/out"
    nodes, edges = _graph(spark, 20)
    statements.export(nodes, edges, uri)
    before = sorted(p.name for p in pathlib.Path(tmp_path, "out").iterdir())
    bad = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 35, "neither").otherwise("nodes").alias("stage"), F.lit("s").alias("statement"), F.expr("array(map('id', string(id)))").alias("rows"))
    with pytest.raises(Exception, match="not nodes or edges"):
        bad.write.format("merge_statements").mode("append").save(uri)
    assert sorted(p.name for p in pathlib.Path(tmp_path, "out").iterdir()) == before
