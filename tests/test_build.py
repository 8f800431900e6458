import json
import os

import pytest

from lattica.operators import bm25
from lattica.operators.project import Options
from lattica.plans import build
from lattica.sources import documents

OPTIONS = Options("git@host:me/repo.git", "a" * 40, "2024-01-01T00:00:00Z")


def bundle_at(root, header="type: T\ntitle: One\ndescription: d\ntags: [x]\n"):
    root.mkdir()
    (root / "index.md").write_text("# All\n\n- [one](one.md)\n")
    (root / "one.md").write_text(f"---\n{header}---\nText to [all](index.md).\n")
    return str(root)


def test_only_valid_bundles_are_projected(spark, tmp_path):
    made, parsed = build.build(spark, bundle_at(tmp_path / "good"), OPTIONS)
    assert parsed.count() == 2 and [r["title"] for r in made.nodes.filter("kind = 'Concept'").collect()] == ["One"]
    assert build.export(made, str(tmp_path / "out")) == build.export(made, str(tmp_path / "out"))
    build.export_files(made, str(tmp_path / "json"))
    lines = lambda name: [json.loads(x) for f in sorted((tmp_path / "json" / name).glob("part-*")) for x in f.read_text().splitlines()]
    assert [n["id"] for n in lines("nodes")] == [r["id"] for r in made.nodes.orderBy("pos").collect()] == [n["id"] for n in lines("flat_nodes")]
    assert [e["id"] for e in lines("edges")] == [r["id"] for r in made.edges.orderBy("pos").collect()] == [e["id"] for e in lines("flat_edges")]
    assert len(lines("flat_nodes")[0]) == 24 and lines("flat_nodes")[0]["repository"] == "git@host:me/repo.git" and [m["nodes"] for m in lines("manifest")] == [2]
    with pytest.raises(build.InvalidBundle, match="TYPE_REQUIRED"):
        build.build(spark, bundle_at(tmp_path / "bad", "title: One\n"), OPTIONS)
    warned = bundle_at(tmp_path / "warned", "type: T\nstatus: old\n")
    build.build(spark, warned, OPTIONS)
    with pytest.raises(build.InvalidBundle, match="INVALID_STATUS"):
        build.build(spark, warned, OPTIONS, strict=True)


@pytest.mark.parametrize("when", ["2024-99-99T99:99Z", "2024-02-30T00:00Z", "2024-01-01T00:00:00"])
def test_options_take_real_times_only(when):
    with pytest.raises(ValueError):
        Options("r", "a" * 40, when)


def test_documents_are_read_within_bounds(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a b").mkdir(parents=True)
    (root / "a b" / "é+.md").write_text("one")
    (root / "large.md").write_bytes(b"x" * (documents.MOST_BYTES + 1))
    (root / "raw.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "out.md").write_text("secret")
    os.symlink(tmp_path / "out.md", root / "link.md")
    read = lambda *paths, commit="c": documents.read_documents(spark, str(root), paths, commit, "c").collect()
    assert [tuple(r) for r in read("a b/é+.md", "a b/é+.md")] == [("a b/é+.md", "one", "c")] and read() == []
    for bad in (["../out.md"], ["/etc/x.md"], ["a b/../large.md"], ["x.txt"], ["link.md"], ["large.md"], ["raw.md"], ["none.md"]):
        with pytest.raises(documents.Refused):
            read(*bad)
    with pytest.raises(documents.Refused):
        read("a b/é+.md", commit="d")


def test_chunks_keep_their_rule_over_whole_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        body = (r.text or "").replace("\n", "\n\n")
        blocks = [b.strip() for b in body.split("\n\n") if b.strip()]
        flow = "\n\n".join(blocks)
        for most, overlap in ((300, 0), (1000, 160)):
            chunks = bm25.chunk_texts(body, most, overlap)
            at = reach = 0
            for k, chunk in enumerate(chunks):
                here = flow.index(chunk, max(0, reach - overlap - 2))
                # nothing but white space is left out, and no more than the overlap repeated
                assert not flow[reach:here].strip() and here >= at and reach - here <= overlap
                assert len(chunk) <= most or k == 0
                at, reach = here, here + len(chunk)
                nxt = flow[reach:].lstrip("\n").split("\n\n")[0]
                if k + 1 < len(chunks) and flow[reach : reach + 2] == "\n\n" and k:
                    assert reach - here + 2 + len(nxt) > most - 2 * overlap
            assert not flow[reach:].strip()
