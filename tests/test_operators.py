import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import expressions as X
from quarrygraph.operators import assistant, configs, live, relations, scope, search, texts, trace, versions
from quarrygraph.sources import content
from quarrygraph.streaming import sync


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "path"), [
    ("/event_groups/:id/participants", "/event_groups/*/participants"), ("/a/b?page=2", "/a/b"), ("/a(.:format)", "/a"), ("https://h.example.com/v1/trade/home", "/v1/trade/home"),
    ("/trade/home/", "/trade/home"), ("//Trades//x", "/Trades/x"), ("", "/"),
])
def test_endpoint_path(spark, url, path):
    assert one(spark, X.endpoint_path(F.lit(url))) == path


def test_words_of_a_question(spark):
    q = F.lit("What does the switch custom_po_enabled do and who has it on?")
    assert one(spark, X.identifier_keys(q)) == ["custom_po_enabled"]
    words = one(spark, X.content_words(q))
    assert "switch" in words and "does" not in words
    assert one(spark, X.content_words(F.lit("the and of"))) == []


def test_trigram_similarity(spark):
    assert round(one(spark, X.trigram_similarity(F.lit("word"), F.lit("two words"))), 4) == 0.3636
    assert one(spark, X.trigram_similarity(F.lit(""), F.lit(""))) == 0.0


def test_masks_and_gates(spark):
    assert one(spark, X.mask_personal(F.lit("mail priya@example.com or call +91 98765 43210 now"))) == "mail [email] or call [phone] now"
    assert one(spark, F.size(X.secret_tokens(F.lit("key = abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71")))) == 1
    assert one(spark, X.html_text(F.lit("<p>a &amp; b</p><script>x()</script>"))) == "a & b"
    assert one(spark, X.underscore(F.lit("Api::TradeLine"))) == "api/trade_line"
    assert one(spark, X.slug(F.lit(" A  b! "))) == "a-b"
    assert one(spark, X.json_contains(F.lit('{"a": {"b": true, "c": "x"}}'), {"a": {"b": True, "c": "x"}})) is True
    assert one(spark, X.json_contains(F.lit('{"a": 1}'), {"a": 2})) is False


EDGE = "edge_id string, kind string, src string, dst string, commit int, confidence double, resolution string"


def graph(spark, pairs, kind="CALLS", commit=1):
    return spark.createDataFrame([(f"{a}-{b}-{i}", kind, a, b, commit, 0.9, "EXACT") for i, (a, b) in enumerate(pairs)], EDGE)


def scope_of(spark, commit=1):
    return spark.createDataFrame([("r", "main", commit)], "repo string, ref string, commit int")


def walk(spark, pairs, root="a", **options):
    rows = trace.trace(graph(spark, pairs), scope_of(spark), root, max_rows=None, **options).collect()
    return sorted((r["depth"], ">".join(r["path"])) for r in rows)


def test_trace_breaks_cycles_and_keeps_paths(spark):
    assert walk(spark, [("a", "b"), ("b", "a")]) == [(1, "a>b")]
    assert walk(spark, [("a", "a"), ("a", "b")])[:2] == [(1, "a>a"), (1, "a>b")]
    assert walk(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])[-2:] == [(2, "a>b>d"), (2, "a>c>d")]
    assert walk(spark, [("a", "b"), ("b", "c")], depth=1) == [(1, "a>b")]


def test_trace_stops_at_hubs_but_not_at_the_root(spark):
    pairs = [("a", "h"), ("h", "z"), *[(f"x{i}", "h") for i in range(3)]]
    assert walk(spark, pairs, hub_above=3) == [(1, "a>h")]
    assert walk(spark, pairs, hub_above=4) == [(1, "a>h"), (2, "a>h>z")]
    assert walk(spark, pairs, hub_above=3, expand_hubs=True) == [(1, "a>h"), (2, "a>h>z")]
    assert walk(spark, pairs, root="h", hub_above=3) == [(1, "h>z")]


def test_trace_scope_confidence_and_opposed_edges(spark):
    served = graph(spark, [("route", "part")], kind="SERVES")
    rows = trace.trace(served, scope_of(spark), "part", max_rows=None).collect()
    assert [(r["src"], r["dst"]) for r in rows] == [("part", "route")]
    assert trace.trace(served, scope_of(spark), "route", direction="reverse", max_rows=None).count() == 1
    assert trace.trace(served, scope_of(spark, 2), "part", max_rows=None).count() == 0
    assert trace.trace(served.withColumn("confidence", F.lit(0.5)), scope_of(spark), "part", max_rows=None).count() == 0
    many = graph(spark, [("a", f"b{i}") for i in range(9)])
    assert trace.trace(many, scope_of(spark), "a", max_rows=4).count() == 5  # one more tells of truncation


def test_shortest_paths(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    found = {(r["start"], r["node"]): r["hops"] for r in trace.shortest_paths(links, spark.createDataFrame([("a",)], "node string")).collect()}
    assert found == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1}


def test_scope_takes_the_commit_last_seen(spark):
    refs = spark.createDataFrame([("r", "main", 1, "2020"), ("r", "main", 2, "2019"), ("r", "dev", 3, "2020")], "repo string, ref string, commit int, last_seen string")
    assert [r["commit"] for r in scope.resolve_scope(refs).collect()] == [1]
    rows = spark.createDataFrame([("x", 1), ("y", 3), ("z", None)], "id string, commit int")
    assert {r["id"] for r in scope.in_scope(rows, scope.resolve_scope(refs)).collect()} == {"x", "z"}


def test_diff_treats_null_and_empty_paths_alike(spark):
    s = "kind string, id string, path string"
    a = spark.createDataFrame([("K", "1", None), ("K", "2", "p"), ("K", "3", "p")], s)
    b = spark.createDataFrame([("K", "1", ""), ("K", "2", "q"), ("K", "4", "p")], s)
    assert {(r["id"], r["change"]) for r in versions.entity_diff(a, b).collect()} == {("2", "moved"), ("3", "removed"), ("4", "added")}


def test_retention(spark):
    refs = spark.createDataFrame([("r", "main", c, str(c)) for c in range(5)] + [("r", "old", 0, "0")], "repo string, ref string, commit int, last_seen string")
    assert {r["commit"] for r in versions.survivors(refs, 2).collect()} == {0, 3, 4}
    with pytest.raises(ValueError):
        versions.survivors(refs, 1)


def test_carry_forward_needs_both_ends_unchanged(spark):
    s = "kind string, id string, blob string"
    old = spark.createDataFrame([("K", "a", "1"), ("K", "b", None), ("K", "c", "1")], s)
    new = spark.createDataFrame([("K", "a", "1"), ("K", "b", None), ("K", "c", "2")], s)
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "gone")], "src string, dst string")
    assert [(r["src"], r["dst"]) for r in versions.carry_forward(edges, old, new).collect()] == [("a", "b")]


def test_layers_of_configuration(spark):
    owners = spark.createDataFrame([(1, "g"), (2, "h")], "owner int, grp string")
    defaults = spark.createDataFrame([("k", "d")], "config_key string, value string")
    masters = spark.createDataFrame([("g", "k", "m")], "grp string, config_key string, value string")
    o = "owner int, config_key string, value string, active boolean, at int"
    overrides = spark.createDataFrame([(1, "k", "x", False, 9), (2, "k", "a", True, 1), (2, "k", None, True, 2)], o)
    assert {r["owner"]: (r["value"], r["source"]) for r in configs.effective(owners, defaults, masters, overrides).collect()} == {1: ("m", "master"), 2: (None, "override")}


def test_live_queries_refuse_what_is_not_allowed(spark):
    rows = spark.createDataFrame([(i, "x" * 700, i) for i in range(4)], "id int, body string, ts int")
    assert live.query_live(rows, ["id", "ts"], limit=0, key="id").collect()[0]["id"] == 3
    assert live.query_live(rows, ["id", "body", "ts"], limit=9999).count() == 4
    assert len(live.query_live(rows, ["body", "ts"]).first()["body"]) == 601
    with pytest.raises(ValueError):
        live.query_live(rows, ["id"], columns=["body"])
    with pytest.raises(ValueError):
        live.live_total(rows, ["id"], where={"body": "x"})
    assert live.live_total(rows, ["id"], where={"id": [1, 2]}).first()["total"] == 2
    assert live.live_total(rows, ["id"], where={"id": None}).first()["total"] == 0


def test_clear_top(spark):
    def kept(scores, **o):
        rows = spark.createDataFrame([("g", f"k{i}", s) for i, s in enumerate(scores)], "g string, k string, s double")
        return sorted(r["k"] for r in search.clear_top(rows, "g", "k", "s", **o).collect())

    assert kept([0.81, 0.79, 0.66, 0.63]) == ["k0", "k1"]
    assert kept([0.81, 0.70, 0.66]) == ["k0"]
    assert kept([0.70, 0.69, 0.68, 0.67]) == []
    assert kept([0.40], floor=0.5) == []


def test_fusion(spark):
    lists = [spark.createDataFrame(r, "id string, rank int") for r in ([("x", 1), ("y", 2), ("z", 3)], [("y", 1), ("w", 2)])]
    rows = search.fuse(lists, "id").orderBy(F.desc("fused")).collect()
    assert rows[0]["id"] == "y" and len(rows) == 4


def test_follow_ups(spark):
    ask = lambda t: one(spark, assistant.needs_context(F.lit(t)))
    assert ask("And for the other customer?") and ask("show me that template") and not ask("")
    assert not ask("Which endpoints does the purchase order screen of the dashboard call when somebody saves a new order line today?")


def test_roles(spark):
    nodes = spark.createDataFrame([("a", "SYMBOL", "p"), ("b", "HTTP_ENDPOINT", "p"), ("c", "FEATURE", "p")], "id string, kind string, path string")
    seen = lambda role: {(r["id"], r["path"]) for r in assistant.visible(nodes, role).collect()}
    assert seen("cs") == {("c", None)} == seen("nobody")
    assert seen("qa") == {("a", None), ("b", None), ("c", None)}
    assert seen("engineer") == {("a", "p"), ("b", "p"), ("c", "p")}
    assert assistant.allowed_refs("cs", ["dev"]) == ["main"] and assistant.allowed_refs("qa", ["dev"]) == ["dev"]
    assert one(spark, assistant.scrub(F.lit("Api::Trade#show calls GET /v1/x in app/a.rb"))) == "the system calls the API in a file"


def test_tickets_and_verdicts(spark):
    t = one(spark, assistant.parse_ticket(F.lit('Customer: Acme\nSubject: Bid\nIt says "cannot save the bid"')))
    assert (t["customer"], t["subject"], t["errors"]) == ("Acme", "Bid", ["cannot save the bid"])
    facts = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (1, 0, 1, 0, 0, 1)], "guides int, screens int, set_switches int, error_hits int, defects int, code_anchors int")
    assert sorted(len(r["v"]) for r in facts.select(assistant.allowed_verdicts().alias("v")).collect()) == [1, 4]


def test_confidence(spark):
    names = "exact int, approximate int, misses int, lookups int, sem_top double, sem_margin double, strong_docs int, screens_named int, journey_ordered boolean, live_rows int, complete_list boolean, source_read boolean, unresolved int, truncated boolean"
    base = dict(exact=0, approximate=0, misses=0, lookups=1, sem_top=0.0, sem_margin=0.0, strong_docs=0, screens_named=0, journey_ordered=False, live_rows=0, complete_list=False, source_read=False, unresolved=0, truncated=False)
    rows = [base | x for x in ({"exact": 1}, {"exact": 1, "unresolved": 1, "strong_docs": 1}, {"misses": 1}, {"approximate": 1}, {"live_rows": 2}, {"strong_docs": 1, "sem_top": 0.7})]
    got = [r["l"] for r in spark.createDataFrame(pd.DataFrame(rows), names).coalesce(1).select(assistant.confidence_level().alias("l")).collect()]
    assert got == ["high", "high", "low", "low", "high", "medium"]


def test_chats(spark):
    old = spark.createDataFrame([(1, 1), (1, 2)], "conv_id int, seq int")
    new = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (2, 1, "c")], "conv_id int, at int, text string")
    assert sorted((r["conv_id"], r["text"], r["seq"]) for r in assistant.append_turns(old, new).collect()) == [(1, "a", 3), (1, "b", 4), (2, "c", 1)]
    events = pd.Series(['[{"type": "done"}]', None])
    assert list(assistant.unzipped(assistant.zipped(events))) == list(events)


def test_templates(spark):
    from quarrygraph.operators import layouts

    docs = [None, "{bad", '{"price": [{"name": "p"}], "inline_components": [{"name": "b", "priority": 2}, {"name": "a", "priority": 1}]}', '[{"order": 2, "name": "B", "page_headers": [{"name": "q"}]}, {"order": 1, "name": "A"}]',
            '{"unit_price": {"input_type": 1}}', '{"k": [{"name": "x"}]}']
    rows = {r["id"]: r for r in layouts.template_layouts(spark.createDataFrame(list(enumerate(docs)), "id int, widgets string")).collect()}
    assert rows[0]["layout"] == rows[1]["layout"] == "empty"
    assert (rows[2]["layout"], rows[2]["groups"], rows[2]["widgets"]) == ("sheet", ["inline_components", "price"], ["a", "b", "p"])
    assert rows[3]["groups"] == ["A", "B"] and rows[3]["widgets"] == ["q"] and rows[4]["widgets"] == ["unit price"] and rows[5]["layout"] == "sheet"


def test_flows(spark):
    steps = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2)], "flow int, step string, position int")
    links = spark.createDataFrame([(1, "b", "a"), (1, "a", "zzz")], "flow int, src string, dst string")
    assert sorted(tuple(r) for r in assistant.valid_flow(steps, links).collect()) == [(1, "b", "a"), (2, "c", "d")]


def test_passages():
    text = "# A\nintro\n## B\n```\n# not a heading\n```\nmore\n# C\n" + "\n\n".join(" ".join(["w"] * 120) for _ in range(5))
    found = texts.cut_passages(text)
    assert [p[0] for p in found[:2]] == ["A", "A > B"] and "not a heading" in found[1][1]
    assert sum(p[0] == "C" for p in found) >= 2 and max(p[2] for p in found) <= 360
    assert texts.cut_passages("") == []


def test_mentions_and_reads(spark):
    docs = spark.createDataFrame([(1, "FxResponse and Api::V1::TradeController#quote_details use rule_group_mappings"), (2, None)], "doc_id long, text string")
    names = {r["name"] for r in texts.mentions(docs).collect()}
    assert names == {"const:FxResponse", "const:Api::V1::TradeController", "method:Api::V1::TradeController#quote_details", "snake:rule_group_mappings", "snake:quote_details"}
    long = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 301)))], "doc_id long, text string")
    rows = texts.read_lines(long, 2, 300).collect()
    assert len(rows) == 120 and rows[0]["content"] == "l2" and rows[0]["truncated"]
    with pytest.raises(ValueError):
        texts.grep(long, "ab")
    hit = texts.grep(long, "l300").first()
    assert (hit["line"], hit["context"]) == (300, "l298\nl299\nl300")
    assert texts.readable(spark.createDataFrame([("a/.env",), ("a/b.rb",)], "path string")).count() == 1


def test_screens_named(spark):
    names = spark.createDataFrame([(1, "purchase order"), (2, "po")], "screen int, name string")
    q = spark.createDataFrame([(7, "Where is the Purchase Order, or PO?")], "item_id int, text string")
    found = {r["screen"]: r["position"] for r in relations.named_in(names, q).collect()}
    assert set(found) == {1, 2} and found[1] < found[2]


def test_sync_is_idempotent(spark):
    s = "id int, ts int, v string"
    mirror, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], s), spark.createDataFrame([(1, 2, "A"), (3, 1, "c"), (1, 0, "late")], s)
    once = sync.apply_changes(mirror, new, "id", "ts")
    want = {(1, 2, "A"), (2, 1, "b"), (3, 1, "c")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in sync.apply_changes(once, new, "id", "ts").collect()}
    stays, gone = sync.reconcile(once, spark.createDataFrame([(1,), (3,)], "id int"), "id")
    assert stays.count() == 2 and [r["id"] for r in gone.collect()] == [2]


def test_streamed_mirror_equals_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    rows = sync.stream(spark, folder, events.schema, 1)
    sync.mirror(rows, str(tmp_path / "out"), str(tmp_path / "check"), "user_id", "ts").awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).agg(F.max("generation")).first()[0]
    got = spark.read.parquet(f"{tmp_path}/out/generation={last}").select("user_id", "ts", "event_id")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in sync.latest(events.select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "ts", "event_id").collect()}


def test_streamed_windows_and_deduplication(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.union(events).write.parquet(folder)
    unique = sync.deduplicated(sync.stream(spark, folder, events.schema), "event_id", "ts", "60 days")
    q = unique.writeStream.format("memory").queryName("unique_events").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_events").count() == events.count()
    q = sync.windowed_counts(sync.stream(spark, folder, events.schema), "ts", "event_type").writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("window_counts").agg(F.sum("n")).first()[0] == 2 * events.count()


def test_git_source_and_extraction_cache(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.rb").write_text("class Trade::Line\nend\ncreate_table :lines\n")
    (tmp_path / "b.js").write_text("api.get(`/orders/${id}/lines`)")
    (tmp_path / ".env").write_text("x")
    (tmp_path / "bin").write_bytes(b"\0\1")
    run("add", "-f", ".")
    run("commit", "-qm", "first")
    tree = content.git_tree(spark, str(tmp_path), "HEAD").withColumn("commit", F.lit("HEAD"))
    assert {r["path"] for r in content.indexable(tree).collect()} == {"a.rb", "b.js", "bin"}
    got = content.git_texts(content.indexable(tree), str(tmp_path))
    none = spark.createDataFrame([], "blob string, extractor string, version string")
    facts = content.new_facts(tree, got, none, "symbols", "1", content.symbols)
    assert [(r["path"], r["fact"]) for r in content.resolve(tree, facts).collect()] == [("a.rb", "Trade::Line")]
    assert content.new_facts(tree, got, facts, "symbols", "1", content.symbols).count() == 0
    assert content.new_facts(tree, got, facts, "symbols", "2", content.symbols).count() == 1
    calls = content.new_facts(tree, got, none, "calls", "1", content.call_sites)
    assert [r["fact"] for r in calls.collect()] == ["GET /orders/*/lines"]
    assert [r["fact"] for r in content.new_facts(tree, got, none, "tables", "1", content.tables_created).collect()] == ["lines"]


# --- guarded SQL, anchors, screens, events, JSON, sinks ---


def test_only_single_queries_pass_the_guard(spark):
    from quarrygraph.operators import guard

    assert guard.read_only(spark, " select 1 ; ") == "select 1 " and guard.read_only(spark, "-- c\nWITH x AS (SELECT 1 AS a) SELECT * FROM x UNION SELECT 2")
    bad = ["update t set a=1", "insert into t values (1)", "delete from t", "create table t(x int)", "drop table t", "truncate table t", "select 1; delete from t", "/* c */ update t set a=1",
           "-- c\nupdate t set a=1", "copy t to stdout", "alter table t add column x int", "with x as (select 1) insert into t select * from x", "set a = 1", "select java_method('java.lang.System', 'exit', 1)", ""]
    for text in bad:
        with pytest.raises(ValueError, match="refused"):
            guard.read_only(spark, text)
    t = spark.range(500).withColumnRenamed("id", "n")
    assert guard.run_sql(spark, "select n from t where n > (select min(n) from t)", {"t": t}).count() == guard.CAP + 1
    with pytest.raises(ValueError, match="unknown table"):
        guard.run_sql(spark, "select * from t where n in (select n from other)", {"t": t})
    assert guard.capped(t).first().asDict() == {"row_count": 200, "capped": True} and guard.capped(t.limit(3)).first().asDict() == {"row_count": 3, "capped": False}


def test_anchor_prefers_exact_then_similar_names(spark):
    from quarrygraph.operators import anchor

    entities = spark.createDataFrame(
        [("be:bids#create", "HANDLER", "bids#create", "app/controllers/bids_controller.rb"), ("be:sym:BidHelper", "SYMBOL", "BidHelper", "app/helpers/bid_helper.rb"), ("t:bids", "DB_TABLE", "trade_bids", None), ("POST /bids", "HTTP_ENDPOINT", "POST /bids", "/bids")],
        "id string, kind string, name string, path string",
    )
    asked = [(1, "What does BIDHELPER do?"), (2, "who calls bids#create when trade_bids changes"), (3, "open bid_helper.rb please"), (4, "what is trade_bid"), (5, "the and of"), (6, "hello moon")]
    got = {r["item_id"]: (r["id"], r["match"]) for r in anchor.anchor(entities, spark.createDataFrame(asked, "item_id int, text string")).collect()}
    assert got == {1: ("be:sym:BidHelper", "exact"), 2: ("t:bids", "exact"), 3: ("be:sym:BidHelper", "exact"), 4: ("t:bids", "approximate")}


def test_files_belong_to_screens_by_folder_and_import(spark):
    from quarrygraph.operators import screens

    files = spark.createDataFrame([("src/views/orders/list.jsx",), ("src/views/orders/new/form.jsx",), ("src/components/table.jsx",), ("src/util/money.js",), ("src/util/far.js",), ("src/views/ordersx/a.jsx",)], "path string")
    folders = spark.createDataFrame([("src/views/orders", "orders"), ("src/views/orders/new", "new order")], "folder string, owner string")
    imports = spark.createDataFrame([("src/views/orders/list.jsx", "src/components/table.jsx"), ("src/components/table.jsx", "src/util/money.js"), ("src/util/money.js", "src/util/far.js")], "path string, imported string")
    got = {r["path"].split("/")[-1]: (r["owner"], r["hops"]) for r in screens.owners(files, folders, imports).collect()}
    assert got == {"list.jsx": ("orders", 0), "form.jsx": ("new order", 0), "table.jsx": ("orders", 1), "money.js": ("orders", 2)}
    clicks = spark.createDataFrame([("f", 5, "save"), ("f", 40, "open"), ("g", 1, "far")], "path string, line int, mark string")
    targets = spark.createDataFrame([("f", 41, "a"), ("f", 5, "b"), ("f", 4, "c"), ("g", 82, "d"), ("g", 81, "e")], "path string, line int, target string")
    assert {r["target"]: r["mark"] for r in screens.nearest_above(targets, clicks, "path", "line").collect()} == {"a": "open", "b": "save", "c": None, "d": None, "e": "far"}
    owned = spark.createDataFrame([("f", "orders")], "path string, owner string")
    goes = spark.createDataFrame([("f", 41, "new order"), ("f", 42, "orders"), ("f", 43, "nowhere")], "path string, line int, to string")
    edges = {(r["src"], r["dst"], r["confidence"]) for r in screens.navigation_edges(owned, goes, clicks, spark.createDataFrame([("orders",), ("new order",)], "screen string")).collect()}
    assert edges == {("orders", "new order", 0.8), ("open", "new order", 0.6)}


def test_events_by_role(spark):
    rows = [("context_paths", None, "a/b.rb", None), ("evidence", "SYMBOL", "app/x.rb", None), ("evidence", None, "uploads/rules.md", None), ("claim", "HTTP_CALL_SITE", None, "x"), ("token", None, None, "See `app/services/bid_service.rb:40` for the check."), ("token", None, None, "Api::V1::TradeController#quote_details then calls POST /bids.")]
    events = spark.createDataFrame(rows, "type string, kind string, path string, text string")
    cs = assistant.filter_events(events, "cs").collect()
    assert [r["text"] for r in cs if r["type"] == "token"] == ["See a file for the check.", "the system then calls the API."] and len(cs) == 3 and {r["path"] for r in cs} == {None}
    assert assistant.filter_events(events, "engineer").collect() == events.collect() and assistant.filter_events(events, "qa").count() == 5
    names = spark.createDataFrame([("SYMBOL", "Bid#validate"), ("DB_TABLE", "trade_requests"), ("FEATURE", "Bidding"), ("ROUTE", "POST /bids")], "kind string, name string")
    assert {(r[0], r[1]) for r in assistant.code_names(names, "cs").collect()} == {("Bid#validate", "the system"), ("trade_requests", "the database"), ("POST /bids", "the API")}
    assert assistant.code_names(names, "engineer").count() == 0


def test_json_and_sinks(spark):
    doc = F.lit('{"a": [1, {"b": "x"}], "n": null, "t": true, "s": "1"}')
    for wanted, held in (({"a": [1]}, True), ({"a": [{"b": "x"}]}, True), ({"a": [2]}, False), ({"n": None}, True), ({"t": True}, True), ({"s": 1}, False), ({"s": "1"}, True), ({"m": None}, False), ({}, True)):
        assert one(spark, X.json_contains(doc, wanted)) is held, wanted
    assert one(spark, X.json_has_key(doc, "n")) is True and one(spark, X.json_has_key(doc, "z")) is False
    assert one(spark, X.json_merge(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": "x", "c": [1]}'))) == '{"a":1,"b":"x","c":[1]}'
    entities = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("K", "a", "b", 1, 0.5), ("K", "a", "b", 1, 0.4), ("K", "a", "c", 1, 0.5), ("K", "b", "a", 2, 0.5)], "kind string, src string, dst string, site int, confidence double")
    assert sorted(map(tuple, content.insert_edges(edges.filter("site = 2"), edges, entities).collect())) == [("K", "a", "b", 1, 0.4)]
    merged = versions.merge_features(spark.createDataFrame([("Purchase Orders", "docs", "d.md"), ("purchase-orders", "folder", "app/po"), ("--", "docs", "x")], "name string, origin string, path string")).collect()
    assert [(r["slug"], r["origins"], r["paths"]) for r in merged] == [("purchase-orders", ["docs", "folder"], ["app/po", "d.md"])]
    log = spark.createDataFrame([("\x01Priya@x.com\x022024-01-02T03:04:05Z\n\napp/a.rb\napp/b.rb",)], "entry string")
    assert sorted((r["person"], r["path"]) for r in content.git_log(spark, log).collect()) == [("priya@x.com", "app/a.rb"), ("priya@x.com", "app/b.rb")]
    assert assistant.columns_for("which orders have the highest total?", {"id": "", "name": "", "total": "total|amount", "status": "status|state"}, ["name"]) == ["id", "total"]


def test_mirror_rewrites_touched_buckets_only(spark, tmp_path):
    from quarrygraph.streaming import sync

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(k, 1, "a") for k in range(200)], "k long, ts long, v string").coalesce(1).write.parquet(source)
    run = lambda schema: sync.mirror(sync.stream(spark, source, schema), target, state, "k", "ts", buckets=8).awaitTermination()
    run("k long, ts long, v string")
    before = sync.current(spark, target)
    assert before.count() == 200
    spark.createDataFrame([(3, 2, "b"), (3, 1, "z"), (500, 1, "n")], "k long, ts long, v string").coalesce(1).write.mode("append").parquet(source)
    run("k long, ts long, v string")
    rows = {r["k"]: (r["v"], r["generation"]) for r in sync.current(spark, target).collect()}
    assert len(rows) == 201 and rows[3][0] == "b" and rows[500][0] == "n"
    assert len({k for k, (_, g) in rows.items() if g == 0}) > 100  # buckets without news stay as they were


def test_one_failing_mirror_stops_no_other():
    class Done:
        def awaitTermination(self):
            return None

    def broken():
        raise RuntimeError("no such table")

    from quarrygraph.streaming import sync

    assert sync.mirror_all({"a": broken, "b": Done}) == {"a": "RuntimeError: no such table", "b": None}
