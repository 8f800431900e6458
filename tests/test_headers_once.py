import yaml

from lattica.plans import queries
from lattica.sources import bundle


def test_a_header_is_read_once_by_one_loader(monkeypatch):
    parses, loaders = [], set()
    monkeypatch.setattr(yaml, "parse", lambda source, f=yaml.parse: parses.append(source) or f(source))
    monkeypatch.setattr(yaml, "load", lambda source, loader, f=yaml.load: loaders.add(loader) or f(source, loader))
    assert [bundle.split_header(f"---\na: {k}\nb: [*x]\n---\n".replace("[*x]", "'*'"))[0] for k in (1, 2)] == [{"a": 1, "b": "*"}, {"a": 2, "b": "*"}]
    assert not parses and len(loaders) == 1


def test_wrong_grammar_comes_before_other_faults():
    message = lambda source: str(bundle.split_header(f"---\n{source}\n---\n")[4])
    assert "undefined alias" in message("a: *none")
    assert "undefined alias" not in message("a: *none\nb: [1")
    assert "Excessive" in message("a: &x 1\n" + "\n".join(f"k{n}: *x" for n in range(101)))
    assert message("a: &x 1\n" + "\n".join(f"k{n}: *x" for n in range(100))) == "None"


def test_documents_of_a_small_file_are_parsed_in_many_tasks(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(queries.bundle, "parse", lambda df, f=bundle.parse: parts.append(df.rdd.glom().map(len).collect()) or f(df))
    got = queries.manifest_counts(spark, "/root/testdata/sf0.001").collect()
    assert got[0].documents == sum(parts[0]) and max(parts[0]) < 0.6 * sum(parts[0])
