"""What cannot be read is said: readers with faults beside rows, and three schemes of labels."""

import json

import pytest

from braidline.operators import labels
from braidline.operators.decisions import relation_boolean
from braidline.sources import archive, graphs
from braidline.sources.checked import json_lines


def test_json_lines(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"a": 1, "b": ["x"]}\n\nnot json\n[1]\n{"a": "one"}\n{"b": null, "more": 2}\n')
    found = json_lines(spark, str(tmp_path), "a int, b array<string>")
    assert sorted(map(str, found.rows.collect())) == ["Row(a=1, b=['x'])", "Row(a=None, b=None)"]
    assert found.counts() == {"not JSON": 1, "no object": 1, "another type than the schema's": 1}
    assert {r.record for r in found.faults.collect()} == {"not json", "[1]", '{"a": "one"}'}
    with pytest.raises(ValueError, match="1 x no object"):
        found.under("failfast")
    with pytest.warns(UserWarning, match="1 x not JSON"):
        assert archive.read_views(spark, str(tmp_path), "a int").count() == 2
    with pytest.raises(ValueError, match="is none of"):
        found.under("quiet")


def test_graphs_and_records(spark, tmp_path):
    nodes, edges = graphs.synthetic_trace(spark)
    (tmp_path / "g.json").write_text(graphs.graph_documents(nodes, edges).first().document)
    (tmp_path / "x.json").write_text("{")
    (tmp_path / "y.json").write_text('{"x": 1}')
    assert graphs.checked_graphs(spark, str(tmp_path)).counts() == {"not JSON": 1, "no graph": 1}
    with pytest.warns(UserWarning, match="left out"):
        assert graphs.read_graphs(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError, match="1 x no graph"):
        graphs.read_graphs(spark, str(tmp_path), mode="failfast")
    (tmp_path / "z.jsonl").write_text('{"x": 2}\n7\n[{"x": 3}, 4]\nbad\n')
    assert graphs.checked_records(spark, str(tmp_path)).counts() == {"not JSON": 2, "no object": 2}


def test_sheets_with_line_ends_in_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,note,label\n1,"two\nlines, and ""quotes""",active\n2,x,consumed\n')
    read = archive.read_labels(spark, str(tmp_path / "s.csv"), "id", "label", ("active", "consumed"))
    assert sorted(map(tuple, read.collect())) == [("1", "active"), ("2", "consumed")]


BASE = {"terminal_reason": "consumed", "relation_target_ids": ["s2", "s2"], "obligations": [], "evidence_event_ids": ["e1"], "reactivation_risk": False}
OWN = {"machine": {"disposition": "safe_to_evict"}, "relation": {"current_target_need": "not_needed"}, "boolean": {"required_for_current_target": False, "requirement_uncertain": False}}


@pytest.mark.parametrize("scheme", ["machine", "relation", "boolean"])
def test_label_schemes(spark, scheme):
    good = lambda s, **more: {"span_id": s} | BASE | OWN[scheme] | more
    answer = lambda *items: json.dumps({"labels": list(items)})
    two = (good("s1"), good("s2"))
    cases = {
        "fine": (answer(*two), set()),
        "none": (None, {"no response"}),
        "text": ("hello", {"no object"}),
        "more": (json.dumps({"labels": [], "x": 1}), {"not labels alone"}),
        "flat": (json.dumps({"labels": {}}), {"labels are no list"}),
        "twice": (answer(*two, good("s1")), {"missing or repeated spans"}),
        "fewer": (answer(good("s1")), {"missing or repeated spans"}),
        "span": (answer(good("s1"), good("s9")), {"unknown span", "missing or repeated spans"}),
        "reason": (answer(good("s1", terminal_reason="tired"), two[1]), {"unknown reason"}),
        "target": (answer(good("s1", relation_target_ids=["s9"]), two[1]), {"unknown target"}),
        "evidence": (answer(good("s1", evidence_event_ids=["e9"]), two[1]), {"unknown evidence"}),
        "duty": (answer(good("s1", obligations=["fun"]), two[1]), {"unknown obligation"}),
        "flag": (answer(good("s1", reactivation_risk="no"), two[1]), {"not true or false: reactivation_risk"}),
        "list": (answer(good("s1", obligations=3), two[1]), {"no list: obligations"}),
        "field": (answer(good("s1", extra=1), two[1]), {"missing or further fields"}),
    }
    asked = spark.createDataFrame([(p, ["s1", "s2"], ["e1"]) for p in cases], "package_id string, span_ids array<string>, event_ids array<string>")
    given = spark.createDataFrame([(p, r) for p, (r, _) in cases.items() if r is not None], "package_id string, response string")
    found = labels.read_labels(given, asked, scheme)
    said = {}
    for r in found.faults.collect():
        said.setdefault(r.file, set()).add(r.fault)
    assert said == {p: f for p, (_, f) in cases.items() if f}
    rows = found.rows.collect()
    assert [(r.package_id, r.span_id, r.relation_target_ids, r.disposition) for r in sorted(rows)] == [("fine", s, ["s2"], "safe_to_evict") for s in ("s1", "s2")]


def test_boolean_dispositions(spark):
    rows = [("active", False, False, False, False, "live_noncritical"), ("duplicate", False, False, False, False, "safe_to_evict"), ("duplicate", True, False, False, True, "live_critical"), ("consumed", False, True, False, False, "uncertain"), ("consumed", False, False, False, True, "uncertain"), ("unknown", False, False, False, False, "uncertain"), ("audit_required", False, False, False, False, "live_critical"), ("active", False, False, True, True, "live_critical")]
    df = spark.createDataFrame(rows, "reason string, needed boolean, unsure boolean, obliged boolean, risky boolean, want string")
    assert df.where(relation_boolean(df.reason, df.needed, df.unsure, df.obliged, df.risky) != df.want).isEmpty()
