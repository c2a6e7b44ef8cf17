"""Facts of code, the contract of extractors, template layouts, journeys, imports, and nested facts as roles see them."""

import json

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import journeys, layouts, redaction
from quarrygraph.sources import code, contract, knowledge

RUBY = """module Api
  class TradeController < ApplicationController
    include Pundit
    def quote_details; end
    def self.k; end
    class << self
      def z; end
    end
    def after; end
  end
  class X < Y; end
  def m(x) = x
end
def top; end
"""
HEREDOC = "module M\n  def a\n    x = <<~SQL\nselect 1\nend_marker\n    SQL\n  end\n  def b(y) = y\n  def c; end\nend\n"


def declared(spark, text):
    rows = code.declarations(spark.createDataFrame([("b", text)], "blob string, text string")).orderBy("line").collect()
    return [f"{r['kind']}:{r['name']}" for r in rows]


def test_declarations_and_their_owners(spark):
    assert declared(spark, RUBY) == ["module:Api", "class:Api::TradeController", "method:Api::TradeController#quote_details", "class_method:Api::TradeController.k", "class_method:Api::TradeController.z", "method:Api::TradeController#after", "class:Api::X", "method:Api#m"]
    assert declared(spark, HEREDOC) == ["module:M", "method:M#a", "method:M#b", "method:M#c"]
    assert declared(spark, "class Fx\n  def a(x) = x + 1\n  private_class_method def self.b; end\n  def c\n  end\nend\n") == ["class:Fx", "method:Fx#a", "class_method:Fx.b", "method:Fx#c"]
    assert declared(spark, "module H\n  included do\n    class << self\n      def all_cached; end\n    end\n  end\nend") == ["module:H", "class_method:H.all_cached"]
    assert declared(spark, "class A\n  class B\n    def x\nend\nclass C\n  def y; end\nend") == ["class:A", "class:A::B", "method:A::B#x", "class:C", "method:C#y"]  # what isn't closed ends with what it stands in
    assert declared(spark, "") == declared(spark, "def lone; end") == []
    found = code.declarations(spark.createDataFrame([("b", RUBY)], "blob string, text string"))
    edges = {(r["src"], r["dst"]) for r in code.declares(found).collect()}
    assert ("be:sym:Api::TradeController", "be:sym:Api::TradeController.z") in edges and ("be:sym:Api", "be:sym:Api#m") in edges and len(edges) == 5


def sites(spark, text):
    return code.call_sites(spark.createDataFrame([("b", text)], "blob string, text string")).orderBy("line", "col").collect()


def test_call_sites_of_every_shape(spark):
    text = """const a = 1;
promisifiedXHR(`/a/${b}/c`, "post")
  x = promisifiedXHR(url, 'GET'); y = promisifiedXHR("/p?q=1,2")
promisifiedXHR (cond ? "a)" : [f(1, 2)], {x: 1})
promisifiedXHR('it\\'s'
)
promisifiedXHR(promisifiedXHR("/in"), 'PUT')
promisifiedXHR("open"""
    got = [(r["line"], r["col"], r["method"], r["shape"], r["path_template"]) for r in sites(spark, text)]
    assert got == [
        (2, 0, "POST", "TEMPLATE", "/a/*/c"), (3, 6, "GET", "IDENTIFIER", None), (3, 38, None, "LITERAL", "/p?q=1,2"), (4, 0, None, "OTHER", None), (5, 0, None, "LITERAL", "it\\'s"), (7, 0, "PUT", "OTHER", None), (7, 15, None, "LITERAL", "/in"),
    ]
    (far,) = sites(spark, "promisifiedXHR(pick(" + "x, " * 400 + "y), 'GET')")  # an argument beyond the first window
    assert far["shape"] == "OTHER" and far["method"] == "GET" and far["raw"].startswith("pick(x, x,") and (far["confidence"], far["resolution"]) == (0.4, "AMBIGUOUS")
    assert sites(spark, "") == [] and sites(spark, "promisifiedXHR(a") == []
    tree = spark.createDataFrame([("v/a.js", "b")], "path string, blob string")
    edges = code.targets(code.call_sites(spark.createDataFrame([("b", text)], "blob string, text string")), tree, lambda p: F.substring_index(p, "?", 1))
    assert ("fe:v/a.js#L2", "POST /a/*/c") in {(r["src"], r["dst"]) for r in edges.collect()} and edges.count() == 4


def test_extractors_are_cached_by_version_and_read_one_another(spark):
    texts = spark.createDataFrame([("r", RUBY), ("s", "x"), ("bad", "boom")], "blob string, text string")
    tree = spark.createDataFrame([("a/x.rb", "r"), ("b/x.rb", "r"), ("y.js", "s"), ("z.rb", "bad")], "path string, blob string")
    calls = spark.sparkContext.accumulator(0)

    def defs(path, text, facts):
        calls.add(1)
        if text == "boom":
            raise ValueError("cannot read")
        return [("def", line.split()[1], i + 1) for i, line in enumerate(text.split("\n")) if line.strip().startswith("def ")]

    def count(path, text, facts):
        return [("count", path, None, str(len([f for f in facts if f[0] == "defs"])))]

    first, second = contract.Extractor("defs", "1", defs, path=r"\.rb$"), contract.Extractor("count", "1", count, needs=("defs",))
    none = spark.createDataFrame([], contract.FACTS)
    facts = contract.extract(tree, texts, none, [second, first])
    assert {(r["blob"], r["name"], r["value"]) for r in facts.filter("kind = 'count'").collect()} == {("r", "a/x.rb", "6"), ("s", "y.js", "0"), ("bad", "z.rb", "0")}
    assert [(r["blob"], r["extractor"], r["reason"]) for r in contract.failures(facts).collect()] == [("bad", "defs", "ValueError: cannot read")]
    ran = calls.value
    assert contract.extract(tree, texts, facts, [second, first]).count() == facts.count() and calls.value == ran == 2
    more = contract.extract(tree, texts, facts, [contract.Extractor("defs", "2", defs, path=r"\.rb$"), second])
    assert calls.value == ran + 2 and more.filter("extractor = 'defs' and version = '2' and kind = 'def'").count() == 6
    with pytest.raises(ValueError, match="not there"):
        contract.ordered([second])


# --- layouts ---


def laid(spark, *docs):
    return layouts.layouts(spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, widgets string"))


def test_layouts_of_every_kind(spark):
    sheet = {
        "global_price_components": [{"name": "Freight", "input_type": "number", "configuration": {"field_type": "participant", "priority": 1, "prefix": "$"}}],
        "inline_components": [{"name": "Price Cap", "key_attribute": "ceil_price", "configuration": {"field_type": "creator", "priority": 4, "suffix": "/KG"}}, {"name": "Min Quantity", "configuration": {"priority": 2, "is_required": True, "mode_type": "hidden"}}],
        "other_columns": [{"label": "L"}, {"key_attribute": "k"}, {}, 3], "empty": [],
    }
    form = [{"order": 2, "name": "Terms", "page_headers": [], "page_response_headers": [{"name": "Do you agree?", "configuration": {"cell_options": [{"value": "I Agree"}, "no", {}]}}]}, {"order": 1, "page_response_headers": [{"name": "Number"}], "aggregate_level_questions": [{"name": "All?"}]}, 7]
    fields = {"po_number": {"input_type": "string", "configuration": {"priority": 1}}, "status": {"input_type": "dropdown", "configuration": {"priority": 0}}, "title": "x"}
    found = laid(spark, sheet, form, fields, None, "", "not json", "3", "{}", "[]")
    rows = {r["id"]: r for r in found.collect()}
    assert [rows[i]["layout"] for i in range(9)] == ["sheet", "form", "fields", *["empty"] * 5, "form"]
    groups = rows[0]["groups"]
    assert [(g["key"], g["label"]) for g in groups] == [("inline_components", "inline components"), ("global_price_components", "Event-level price components"), ("other_columns", "other columns")]
    assert [w["name"] for g in groups for w in g["widgets"]] == ["Min Quantity", "Price Cap", "Freight", "L", "k", "(unnamed)"]
    least, cap, freight = groups[0]["widgets"][0], groups[0]["widgets"][1], groups[1]["widgets"][0]
    assert least["required"] and least["hidden"] and cap["suffix"] == "/KG" and cap["key"] == "ceil_price" and freight["side"] == "participant" and freight["prefix"] == "$"
    pages = rows[1]["groups"]
    assert [p["key"] for p in pages] == ["Page 2", "Terms"] and [(w["name"], w["side"]) for w in pages[0]["widgets"]] == [("Number", "participant"), ("All?", "aggregate")]
    assert pages[1]["widgets"][0]["options"] == ["I Agree", "no"]
    assert [w["name"] for w in rows[2]["groups"][0]["widgets"]] == ["status", "po number"]
    assert {r["id"]: r["names"] for r in layouts.widget_names(found).collect()}[1] == ["Page 2", "Number", "All?", "Terms", "Do you agree?"]
    assert "Python" not in found._jdf.queryExecution().toString()


def test_mapped_widgets_stand_in_for_empty_templates(spark):
    mapped = spark.createDataFrame([(1, 2, "B", "kb", "date", False, '{"priority": 5, "is_required": true}'), (1, 1, "A", None, None, True, None), (0, 1, "unused", None, None, False, "{}")], "id int, position int, name string, key_attribute string, input_type string, custom boolean, config string")
    rows = {r["id"]: r for r in layouts.with_mappings(laid(spark, {"k": [{"name": "own"}]}, None, None), mapped).collect()}
    assert [(rows[i]["layout"], rows[i]["source"]) for i in range(3)] == [("sheet", "widgets_json"), ("sheet", "widget_mappings"), ("empty", "widgets_json")]
    assert [(w["name"], w["required"], w["custom"], w["input_type"]) for w in rows[1]["groups"][0]["widgets"]] == [("B", True, False, "date"), ("A", False, True, None)]


# --- journeys ---


def test_journeys_follow_the_questions_order(spark):
    links = spark.createDataFrame([(a, b) for a, b in ("ab", "bc", "cd", "de", "ax", "xe", "ef", "pq", "qr", "rs", "st")], "src string, dst string")
    ask = lambda item, nodes: [(item, i, n) for i, n in enumerate(nodes)]
    asked = spark.createDataFrame([*ask(1, "ae"), *ask(2, "ace"), *ask(3, "axce"), *ask(4, "ea"), *ask(5, "aqf"), *ask(6, "aa"), *ask(7, "a"), *ask(8, "pt"), *ask(9, "abxf")], "item_id int, position int, node string")
    got = {r["item_id"]: ("".join(r["path"]), r["covered"]) for r in journeys.routes(links, asked).collect()}
    # c can't be reached any more once x was taken; q never leads to f; nothing leads back; x isn't reached from b
    assert got == {1: ("axe", 2), 2: ("abcde", 3), 3: ("axe", 3), 5: ("axef", 2), 8: ("pqrst", 2), 9: ("abcdef", 3)}


def test_hops_tell_what_is_clicked(spark):
    paths = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a"])], "item_id int, path array<string>")
    screens = spark.createDataFrame([("a", "Home"), ("b", "New Event"), ("c", "New Event"), ("d", "Award")], "node string, name string")
    clicks = spark.createDataFrame([("a", "b", "Create"), ("a", "b", "+"), ("c", "d", "not asked")], "src string, dst string, mark string")
    assert [tuple(r) for r in journeys.hops(paths, screens, clicks).orderBy("hop").collect()] == [(1, 1, "Home", "New Event", "+ / Create"), (1, 2, "New Event", "Award", None)]


# --- imports ---


def test_a_knowledge_base_is_taken_over(spark):
    rows = [
        ("1", "method", "Api::V1::TradeOrdersController#show", "a.rb", 3), ("2", "class", "Api::V1::TradeOrdersController", "a.rb", 1), ("3", "observed_defect", "S3Upload#put!: real call", None, None), ("4", "method", "S3Upload#put!", "s.rb", 1),
        ("5", "observed_defect", "slow", None, None), ("6", "dockerfile", "Dockerfile", "ops/Dockerfile", None), ("7", "route", "GET /x", None, None), ("8", "external_dependency", "checkout", None, None), ("9", "observed_defect", "Gone#away: x", None, None),
    ]
    entities = spark.createDataFrame(rows, "id string, kind string, name string, file_path string, line_start int")
    stored = spark.createDataFrame([("5", "1", "found_in"), ("1", "5", "contains_defect"), ("1", "4", "calls"), ("6", "8", "depends_on"), ("7", "1", "calls")], "from_id string, to_id string, rel_type string")
    handlers = spark.createDataFrame([("be:api/v1/trade_orders#show", "api/v1/trade_orders", "show"), ("be:none#x", "none", "x")], "id string, controller string, action string")
    taken, edges = knowledge.import_edges(entities, stored, handlers)
    assert {r["id"] for r in taken.collect()} >= {"be:file:ops/Dockerfile", "be:external:checkout", "be:defect:slow"} and taken.count() == 8
    assert {(r["kind"], r["src"], r["dst"], r["resolution"]) for r in edges.collect()} == {
        ("TRIGGERS_DEFECT", "be:sym:Api::V1::TradeOrdersController#show", "be:defect:slow", "RUNTIME"), ("CALLS", "be:sym:Api::V1::TradeOrdersController#show", "be:sym:S3Upload#put!", "RUNTIME"), ("USES_SERVICE", "be:file:ops/Dockerfile", "be:external:checkout", "EXACT"),
        ("DECLARES", "be:sym:Api::V1::TradeOrdersController", "be:sym:Api::V1::TradeOrdersController#show", "EXACT"), ("DECLARES", "be:api/v1/trade_orders#show", "be:sym:Api::V1::TradeOrdersController#show", "EXACT"),
        ("TRIGGERS_DEFECT", "be:sym:S3Upload#put!", "be:defect:S3Upload#put!: real call", "HEURISTIC"),
    }
    columns = spark.createDataFrame([("column", "orders.id", "orders", "int"), ("column", "orders.at", "orders", "date"), ("column", "x.y", None, "int")], "kind string, name string, table string, column_type string")
    assert [(r["table"], [tuple(c) for c in r["columns"]]) for r in knowledge.columns_of_tables(columns).collect()] == [("orders", [("at", "date"), ("id", "int")])]


# --- what roles may see ---

NODE = "struct<kind:string,name:string,path:string,text:string,tags:array<string>>"
SECRET = ("SecretHandler", "app/models/secret.rb", "GET /hidden", "Trade::Order#award")


@pytest.fixture(scope="module")
def nested(spark):
    node = lambda kind, name: {"kind": kind, "name": name, "path": "app/models/secret.rb", "text": "see app/models/secret.rb and Trade::Order#award now", "tags": ["plain", "lib/x/y.rb"]}
    value = {"all": [node("HANDLER", "SecretHandler"), node("FEATURE", "Awarding"), None], "one": node("HTTP_ENDPOINT", "GET /hidden"), "by": {"file": node("FEATURE", "dropped by its key"), "k": node("SYMBOL", "SecretHandler"), "f": node("FEATURE", "Bids")}, "n": 3}
    return spark.createDataFrame([(1, "FEATURE", value, "app/models/secret.rb"), (2, "HANDLER", value, None), (3, None, None, None)], f"id int, kind string, f struct<all:array<{NODE}>,one:{NODE},by:map<string,{NODE}>,n:int>, path string")


@pytest.mark.parametrize("role", ["cs", "product", "nobody"])
def test_no_hidden_name_is_left_at_any_depth(nested, role):
    seen = redaction.redact(nested, role)
    said = " ".join(seen.toJSON().collect())
    assert not any(s in said for s in SECRET) and "Awarding" in said and "Bids" in said and "see a file and the system now" in said
    rows = {r["id"]: r for r in seen.collect()}
    assert set(rows) == {1, 3} and "path" not in seen.columns and [x["name"] for x in rows[1]["f"]["all"]] == ["Awarding"] and rows[1]["f"]["one"] is None and rows[1]["f"]["n"] == 3
    assert rows[1]["f"]["by"]["k"] is None and rows[1]["f"]["by"]["f"]["tags"] == ["plain", "a file"] and "file" not in rows[1]["f"]["by"] and rows[3]["f"] is None


def test_roles_that_see_more(nested):
    assert redaction.redact(nested, "engineer").schema == nested.schema
    said = " ".join(redaction.redact(nested, "qa").toJSON().collect())
    assert "SecretHandler" in said and "Trade::Order#award" in said and "secret.rb" not in said
