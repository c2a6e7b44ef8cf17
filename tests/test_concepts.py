"""Features and people over code, route dumps, tickets and intents, whole sets, chosen configurations, and what guided lookups hold."""

from pyspark.sql import functions as F

from quarrygraph.functions import expressions as X
from quarrygraph.operators import anchor, assistant, concepts, configs, live, relations, screens, texts, trace, versions


def ask(spark, expression, *questions):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string").select("i", expression.alias("a")).orderBy("i").collect()
    return [r["a"] for r in rows]


def test_tickets_by_prefix_complaint_label_or_greeting(spark):
    pad = " and so on" * 16
    asked = ["triage: Customer says they cannot see the button", "ticket - x", "How does the approval workflow decide who approves a PO?", "Hi team, the page is blank" + pad, "the buyer is not able to award" + pad, "Subject: award" + pad,
             "All is fine with everything here" + pad, "the buyer" + pad + " but nothing more is told here" + pad + " until an error", None, ""]
    assert ask(spark, assistant.looks_like_ticket("q"), *asked) == [True, True, False, True, True, True, False, False, None, False]


def test_intents(spark):
    asked = ["How does awarding work?", "who calls bids#create", "how does bids#create work", "approve it", "which file holds the guard", "how do I get on", None, "show /orders"]
    assert ask(spark, assistant.intent("q"), *asked) == ["simple", "code", "simple", "simple", "code", "simple", "simple", "code"]
    assert ask(spark, assistant.intent("q", F.lit("simple")), "who calls bids#create") == ["simple"] and ask(spark, assistant.intent("q", F.lit("other")), "who calls bids#create") == ["code"]


def test_features_people_and_activity(spark):
    code = spark.createDataFrame([("a", "SYMBOL", "app/po/x.rb"), ("b", "FILE", "app/po/deep/y.rb"), ("c", "SYMBOL", "app/pods/z.rb"), ("d", "DB_TABLE", "app/po/t.sql"), ("be:sym:Bid", "SYMBOL", "lib/bid.rb"), ("e", "FILE", None)], "id string, kind string, path string")
    features = spark.createDataFrame([("po", ["app/po", "app/po/deep"], ["Bid", "Gone"]), ("none", [], [])], "feature string, dirs array<string>, models array<string>")
    edges = concepts.implements(features, code)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("po", "a"), ("po", "b"), ("po", "be:sym:Bid")} and edges.count() == 3
    touches = spark.createDataFrame([("p", "app/po/x.rb")] * 3 + [("p", "app/po/t.sql"), ("q", "app/po/x.rb")] + [("p", f"f{i:02}") for i in range(70)], "person string, path string")
    owned = {(r["src"], r["dst"]): (r["commits"], r["confidence"]) for r in concepts.owns(touches, code).collect()}
    assert owned == {("person:p", "a"): (3, 0.65), ("person:q", "a"): (1, 0.55)}
    activity = spark.createDataFrame([("app/po/x.rb", 4, "2024-01-02"), ("lib/bid.rb", 1, "2024-03-01")], "path string, commits int, last_commit string")
    (row,) = concepts.feature_activity(edges, code, activity).collect()
    assert tuple(row) == ("po", 5, "2024-03-01", 3, 2)


def test_route_dumps(spark):
    rows = [("GET", "/api/bids/:id", "bids", "show", "vendor"), ("GET", "/api/bids/:id", "bids", "show", "buyer"), ("POST", "/bids", "bids", "create", None), ("GET", "/apiary", None, "x", None)]
    entities, edges = concepts.route_graph(spark.createDataFrame(rows, "verb string, path string, controller string, action string, constraint string"), X.endpoint_path)
    assert sorted(r["id"] for r in entities.collect()) == ["GET /bids/*", "POST /bids", "be:GET /api/bids/:id", "be:POST /bids", "be:bids#create", "be:bids#show"]
    assert {(r["kind"], r["src"], r["dst"], tuple(r["constraints"])) for r in edges.collect()} == {
        ("SERVES", "be:GET /api/bids/:id", "GET /bids/*", ("buyer", "vendor")), ("SERVES", "be:POST /bids", "POST /bids", ()), ("HANDLED_BY", "be:GET /api/bids/:id", "be:bids#show", ()), ("HANDLED_BY", "be:POST /bids", "be:bids#create", ()),
    }


def test_whole_sets_are_fetched_whole(spark):
    t = spark.range(700).select("id", (F.col("id") % 7).alias("g"), F.col("id").alias("ts"))
    n = lambda q, **o: live.completed(q, t, ["id", "g", "ts"], limit=20, **o).count()
    assert n("Which are there?", where={"g": 1}) == 100 and n("show some", where={"g": 1}) == 20 and n("list all of them") == 20  # more than a set may hold


def test_chosen_configurations(spark):
    values = spark.createDataFrame([(1, "a_on", "true", "override"), (1, "b", "false", "default"), (1, "c", "3", "master"), (2, "a_on", "on", "default")], "owner int, config_key string, value string, source string")
    about = spark.createDataFrame([("a_on", "Award", "x"), ("b", "Bid lock", None), ("c", None, "Awards a price")], "config_key string, name string, description string")
    keys = lambda **o: [(r["owner"], r["config_key"]) for r in configs.chosen(values, about, **o).collect()]
    assert keys(keys_like="AWARD") == [(1, "a_on"), (1, "c"), (2, "a_on")] and keys(only="on") == [(1, "a_on"), (2, "a_on")] and keys(only="off") == [(1, "b")] and keys(only="overrides", keys=["a_on", "b"]) == [(1, "a_on")]
    assert len(keys()) == 4 and len(keys(only="anything")) == 4


def test_every_owner_has_every_key_however_many(spark, monkeypatch):
    monkeypatch.setattr(configs, "CHUNK", 7)
    owners = spark.createDataFrame([(1, "g"), (2, "h")], "owner int, grp string")
    defaults = spark.range(50).select(F.concat(F.lit("k"), "id").alias("config_key"), F.lit("d").alias("value"))
    masters = spark.createDataFrame([("g", "k3", "m")], "grp string, config_key string, value string")
    overrides = spark.createDataFrame([(2, "k4", None, True, 2), (2, "k4", "old", True, 1)], "owner int, config_key string, value string, active boolean, at int")
    rows = {(r["owner"], r["config_key"]): (r["value"], r["source"]) for r in configs.effective(owners, defaults, masters, overrides).collect()}
    assert len(rows) == 100 and rows[1, "k3"] == ("m", "master") and rows[2, "k4"] == (None, "override") and rows[2, "k3"] == ("d", "default")


def test_possible_callers_once_each(spark):
    sites = spark.createDataFrame([("a.js", 1, "base + '/Awards'", "AMBIGUOUS"), ("a.js", 9, "url", "AMBIGUOUS"), ("b.js", 2, "url", "AMBIGUOUS"), ("a.js", 3, "awards", "EXACT")], "path string, line int, raw string, resolution string")
    got = relations.possible_callers(sites, spark.createDataFrame([("a.js",)], "path string"), "/x/awards")
    assert [(r["path"], r["line"], r["why"]) for r in got.collect()] == [("a.js", 1, "names_path"), ("a.js", 9, "same_file")]


def test_families_of_one_method(spark):
    ends = spark.createDataFrame([("GET /a", "HTTP_ENDPOINT", "/a", "/a", "GET"), ("POST /a", "HTTP_ENDPOINT", "/a", "/a", "POST")], "id string, kind string, name string, path string, method string")
    edges = spark.createDataFrame([("TARGETS", "s", "GET /a", 1)], "kind string, src string, dst string, commit int")
    scope = spark.createDataFrame([(1,)], "commit int")
    assert [r["id"] for r in relations.family(ends, edges, scope, "/a", method="POST").collect()] == ["POST /a"] and relations.family(ends, edges, scope, "/a").count() == 2


def test_screens_of_one_name(spark):
    screens_ = spark.createDataFrame([(1, "New", "/new/:id"), (2, "New", "/orders/new"), (3, "New", "/n"), (4, "Old", "/old/:id")], "screen int, name string, route string")
    found = spark.createDataFrame([(9, 1, 5), (9, 2, 3), (9, 3, 7), (9, 4, 1)], "item_id int, screen int, position int")
    assert {(r["screen"], r["position"]) for r in relations.one_of_each_name(found, screens_).collect()} == {(3, 7), (4, 1)}


def test_mentions_of_every_kind(spark):
    said = "AwardSheet and Api::Bids, Api::Bids#award! AwardSheet.open_now then trade_bids_2 and x_1y, plain Words Here, a::b, not_THIS HTMLPage"
    rows = {r["name"]: r["n"] for r in texts.mentions(spark.createDataFrame([(1, said), (2, "nothing here"), (3, None), (4, "")], "doc_id int, text string")).collect()}
    assert rows == {"const:AwardSheet": 2, "const:Api::Bids": 2, "method:Api::Bids#award!": 1, "method:AwardSheet.open_now": 1, "snake:trade_bids_2": 1, "snake:open_now": 1, "snake:x_1y": 1}
    many = spark.createDataFrame([(1, " ".join(f"a_{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)))], "doc_id int, text string")
    assert texts.mentions(many).count() == 80


def test_guided_frames(spark):
    entities = spark.createDataFrame([(x, "SYMBOL", x, "f.rb", "r", 1, "b") for x in "abcd"] + [("s", "HTTP_CALL_SITE", "s", "f.rb", "r", 1, "b")], "id string, kind string, name string, path string, repo string, commit int, blob string")
    edges = spark.createDataFrame([("CALLS", "a", "b", 1.0, 1, "EXACT", 1, "1"), ("CALLS", "c", "a", 1.0, 1, "EXACT", 1, "2"), ("CALLS", "s", "d", 0.4, 1, "AMBIGUOUS", 5, "3")], "kind string, src string, dst string, confidence double, commit int, resolution string, line int, edge_id string")
    refs, scope = spark.createDataFrame([("r", "main", 1)], "repo string, ref string, commit int"), spark.createDataFrame([(1,)], "commit int")
    got = anchor.guided(entities, edges, refs, scope, "a")
    assert {(r["side"], r["id"]) for r in got["claims"].collect()} == {("downstream", "b"), ("upstream", "c")}
    assert {r["id"] for r in got["evidence"].collect()} == {"b", "c"} and [r["id"] for r in got["siblings"].collect()] == ["s"]


def test_a_wide_frontier_is_not_sent_to_every_task(spark, monkeypatch):
    edges = spark.createDataFrame([("CALLS", "r", f"m{i}", 1.0, 1, "EXACT", i, f"a{i}") for i in range(40)] + [("CALLS", f"m{i}", f"x{i}", 1.0, 1, "EXACT", i, f"b{i}") for i in range(40)], "kind string, src string, dst string, confidence double, commit int, resolution string, line int, edge_id string")
    scope = spark.createDataFrame([(1,)], "commit int")
    rows = lambda: sorted(tuple(r["path"]) for r in trace.trace(edges, scope, "r", depth=3, max_rows=None).collect())
    small = rows()
    monkeypatch.setattr(trace, "FRONTIER", 5)
    assert rows() == small and len(small) == 80


def test_stored_summaries_take_the_place_of_earlier_ones(spark):
    schema = "repo string, commit int, altitude string, subject_key string, audience string, headline string"
    old = spark.createDataFrame([("r", 1, "system", "s", "all", "old"), ("r", 1, "module", "m", "all", "kept")], schema)
    new = spark.createDataFrame([("r", 1, "system", "s", "all", "new"), ("r", 2, "system", "s", "all", "other commit")], schema)
    assert sorted(r["headline"] for r in versions.store_summaries(old, new).collect()) == ["kept", "new", "other commit"]


def test_routes_and_imports_that_source_declares(spark):
    text = """import a from './a'; const b = require("../b")
const routes = [{ path: '/bids', exact: true, name: 'Bids' }, { path: "/x" }, { path: '/y', component: Y }]"""
    row = spark.createDataFrame([(text,)], "t string").select(screens.routes_declared(F.col("t")).alias("r"), screens.imports_of(F.col("t")).alias("i")).first()
    assert row["r"] == ["/bids Bids"] and sorted(row["i"]) == ["../b", "./a"]


# --- settings, events, reports ---


def test_settings_are_tables(spark, tmp_path):
    import json

    from quarrygraph.sources import settings

    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        return str(tmp_path / name)

    refs = settings.refs(spark, put("refs.json", {"_comment": "x", "front": [{"ref": "main", "tenant": "t", "env": "prod"}, {"ref": "uat"}, {}], "back": []}))
    assert {tuple(r) for r in refs.collect()} == {("front", "main", "t", "prod"), ("front", "uat", None, None)}
    words = settings.tenants(spark, put("tenants.json", {"_comment": "x", "Acme": ["acme%", "%acme inc%"]}))
    assert sorted(tuple(r) for r in words.collect()) == [("acme", "%acme inc%"), ("acme", "acme%")]
    tables = settings.mirrored(spark, put("live.json", {"bids": {"key": "id", "cursor": "updated_at", "columns": ["id", "x"], "large": True}, "odd": 3, "a": {"columns": []}}))
    assert {(r["table"], r["key"], tuple(r["columns"]), r["large"]) for r in tables.collect()} == {("bids", "id", ("id", "x"), True), ("a", None, (), False)}
    owners = spark.createDataFrame([(1, "Acme Ltd", True, 2), (2, "The Acme Inc", True, 5), (3, "Acme gone", False, 9), (4, "Retail_one", True, 0), (5, "Retail one", True, 0)], "owner int, name string, active boolean, overrides int")
    names = spark.createDataFrame([(1, "ACME"), (2, "acme people"), (3, "retail_one"), (4, "no"), (5, None), (6, "acmeish")], "item_id int, name string")
    got = [(r["item_id"], r["owner"]) for r in settings.companies(owners, words, names).orderBy("item_id", F.desc("overrides")).collect()]
    assert got == [(1, 2), (1, 1), (2, 2), (2, 1), (3, 4)]


def test_events_go_out_by_role_and_run(spark, tmp_path):
    from quarrygraph.sources import settings

    rows = [(1, 1, "status", None, None, "reading app/models/bid.rb"), (1, 2, "context_paths", None, "app/x.rb", None), (1, 3, "claim", "HANDLER", None, "secret"), (2, 1, "done", None, None, None)]
    frame = spark.createDataFrame(rows, "run int, seq int, type string, kind string, path string, text string")
    frame.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    settings.event_sink(events, "product", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["run"], r["seq"]): r["frame"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): 'event: status\ndata: {"type":"status","text":"reading a file"}\n\n', (2, 1): 'event: done\ndata: {"type":"done"}\n\n'}
    assert settings.sent(frame, "engineer").count() == 4


def test_reports_are_written(spark, tmp_path):
    from quarrygraph.sources import settings

    results = spark.createDataFrame([(1, "a", True, 2.0, []), (2, "a", False, 4.0, ["links", "words"]), (3, "b", True, 9.0, [])], "id int, grp string, passed boolean, seconds double, failed array<string>")
    settings.write_report(results, "Answers", str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r/report")).collect()]
    assert lines == ["# Answers: 2 of 3 passed, median 4.0 s", "| a | 1 | 2 |", "| b | 1 | 1 |", "- 2: links, words"] and spark.read.json(str(tmp_path / "r/results")).count() == 3


def test_texts_of_earlier_commits_are_filled_in(spark):
    from quarrygraph.sources import settings

    tree = spark.createDataFrame([("x",), ("x",), ("y",), ("bin",)], "blob string")
    texts_ = spark.createDataFrame([("x", "X"), ("y", "Y"), ("bin", "a\0b")], "blob string, text string")
    asked = []

    def read(missing):
        asked.append(sorted(r["blob"] for r in missing.collect()))
        return texts_.join(missing, "blob", "left_semi")

    got = settings.backfill(tree, spark.createDataFrame([("y",)], "blob string"), read)
    assert [tuple(r) for r in got.collect()] == [("x", "X")] and asked == [["bin", "x"]]
