import json

import pytest

from lattica.operators.contract import ContractError
from lattica.sources import store_rows

BASE = {"id": "n", "kind": "Source", "title": "t", "type": "Source", "commitSha": "c", "projectionId": "p", "resource": "r"}


def rows(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v), k, "extra") for k, v in enumerate(values)], "value string, nth int, title string")


@pytest.mark.parametrize(
    "change,errors,column,value",
    [
        ({}, [], "sourceIds", []),
        ({"title": {"gqlType": "STRING", "value": "w"}}, [], "title", "w"),
        ({"title": {"value": "w"}}, ["title"], "title", None),
        ({"title": "  "}, ["title"], None, None),
        ({"title": None}, ["title"], None, None),
        ({"tagsJson": json.dumps(["x"] * 100)}, [], "tags", ["x"] * 100),
        ({"tagsJson": json.dumps(["x"] * 101)}, ["tagsJson"], "tags", []),
        ({"tagsJson": json.dumps(["😀" * 150])}, [], "tags", ["😀" * 150]),
        ({"tagsJson": json.dumps(["😀" * 151])}, ["tagsJson"], "tags", []),
        ({"tagsJson": "[", "aliasesJson": 3}, ["aliasesJson", "tagsJson"], None, None),
        ({"usageCountsJson": "[0, 3.0, 9007199254740991]"}, [], "usageCounts", [0, 3, 2**53 - 1]),
        ({"usageCountsJson": "[9007199254740992]"}, ["usageCountsJson"], None, None),
        ({"usageCountsJson": "[true]"}, ["usageCountsJson"], None, None),
        ({"lastModified": {"gqlType": "X", "value": None}}, [], "lastModified", None),
        ({"lastModified": 1}, ["lastModified"], None, None),
        ({"kind": "Tag", "resource": 5, "usageCountsJson": 7}, ["normalizedValue"], "resource", None),
    ],
)
def test_fields(spark, change, errors, column, value):
    got = store_rows.decode_nodes(rows(spark, BASE | change)).first()
    assert sorted(got["errors"]) == errors and got["nth"] == 0
    assert column is None or got[column] == value


def test_scans_refuse_what_may_be_cut_off_or_wrong(spark):
    some = rows(spark, BASE, BASE | {"id": "m"})
    assert sorted(r["id"] for r in store_rows.scan_nodes(some, 3).collect()) == ["m", "n"]
    with pytest.raises(ContractError, match="2 rows or more"):
        store_rows.scan_nodes(some, 2)
    for bad in ("[]", "nonsense", "3", BASE | {"commitSha": ""}):
        with pytest.raises(ContractError, match="wrong field"):
            store_rows.scan_nodes(rows(spark, BASE, bad))
    edge = {"id": "e", "from": "a", "to": "b", "type": "LINKS_TO", "projectionId": "p", "commitSha": "c", "label": "", "sourcePath": None}
    got = store_rows.scan_edges(rows(spark, edge)).first()
    assert (got["from"], got["label"], got["sourcePath"]) == ("a", None, None)
    assert store_rows.decode_nodes(rows(spark, BASE).limit(0)).collect() == []
    assert store_rows.decode_nodes(spark.createDataFrame([(None,)], "value string")).first()["errors"] == ["row"]
