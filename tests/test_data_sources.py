import http.server
import json
import os
import threading

import pytest

from lattica.sources import bundle, data_sources


def test_tree_reports_links_and_follows_none(spark, tmp_path, monkeypatch):
    root = tmp_path / "b"
    (root / "a b" / "deep").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "node_modules").mkdir()
    for name, text in {"index.md": "# All\n\n- [x](a%20b/é+.MD)\n", "a b/é+.MD": "---\ntype: T\n---\nx\n", "a b/deep/z.md": "z", ".git/no.md": "n", "node_modules/no.md": "n", "a b/no.txt": "n"}.items():
        (root / name).write_text(text)
    (root / "a b" / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "out.md").write_text("secret")
    os.symlink(tmp_path / "out.md", root / "link.md")
    os.symlink(tmp_path, root / "folder")
    os.symlink("nowhere", root / "a b" / "gone")
    monkeypatch.setattr(data_sources, "TASK_FILES", 2)
    tree = data_sources.read_tree(spark, str(root))
    assert sorted((r["path"], r["is_link"]) for r in tree.collect()) == [("a b/bad.md", False), ("a b/deep/z.md", False), ("a b/gone", True), ("a b/é+.MD", False), ("folder", True), ("index.md", False), ("link.md", True)]
    assert len(data_sources.TreeReader(str(root)).partitions()) == 4
    for path in (str(root), f"file://{root}"):
        docs, found = bundle.read_bundle(spark, path)
        assert sorted(r["path"] for r in docs.collect()) == ["a b/deep/z.md", "a b/é+.MD", "index.md"]
        assert sorted((r["severity"], r["code"], r["path"]) for r in found.collect()) == [("error", "INVALID_UTF8", "a b/bad.md"), ("info", "SYMLINK_SKIPPED", "a b/gone"), ("info", "SYMLINK_SKIPPED", "folder"), ("info", "SYMLINK_SKIPPED", "link.md")]
    assert data_sources.local_path("s3a://x/y") is None
    with pytest.raises(Exception, match="NotADirectory"):
        data_sources.read_tree(spark, str(root / "index.md")).collect()
    (tmp_path / "empty").mkdir()
    assert data_sources.read_tree(spark, str(tmp_path / "empty")).collect() == []


@pytest.fixture
def endpoint():
    node = {"id": "n", "kind": "Concept", "title": "t", "type": "T", "tags": ["x"], "aliases": [], "path": "n.md"}
    edge = {"id": "e", "from": "n", "to": "n", "type": "LINKS_TO"}
    whole = {"schemaVersion": "1", "okfVersion": "0.2", "source": {"repository": "r", "commitSha": "c"}, "nodes": [node, node | {"id": "m", "usageCounts": [3]}], "edges": [edge]}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/good")
                self.end_headers()
                return
            body = {"/good": json.dumps(whole), "/bad": "[1]", "/text": "no"}.get(self.path, "{}").encode()
            self.send_response(200 if self.headers.get("Authorization") == "Bearer key" else 401)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_curated_snapshot(spark, endpoint):
    read = lambda path, **o: data_sources.read_curated_snapshot(spark, endpoint + path, **({"token": "key", "allow_insecure_localhost": True} | o))
    nodes, edges, source = read("/good")
    assert [(r["pos"], r["id"], r["tags"], r["usageCounts"]) for r in nodes.orderBy("pos").collect()] == [(0, "n", ["x"], None), (1, "m", ["x"], [3])]
    assert [(r["from"], r["label"]) for r in edges.collect()] == [("n", None)] and source.first()["commitSha"] == "c"
    for path, options, what in (("/bad", {}, "no nodes"), ("/text", {}, "no JSON"), ("/good", {"token": None}, "401"), ("/good", {"most_bytes": 20}, "more than 20 bytes"), ("/moved", {}, "302")):
        with pytest.raises(Exception, match=what):
            read(path, **options)[0].collect()
    for bad in ("http://example.org/x", "https://u:p@example.org/x", "ftp://example.org", endpoint):
        with pytest.raises(ValueError):
            data_sources.read_curated_snapshot(spark, bad)
