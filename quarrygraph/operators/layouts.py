"""Layouts of templates: pages of questions, a sheet of column groups, or flat fields, from JSON of mixed shapes.

Documents are read as VARIANT values within the JVM. What a document holds decides its layout: a list gives
form pages, an object with lists a sheet, an object of widget definitions fields, and anything else is empty. An empty
template may have its widgets in a table of mappings instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the lists of a form page and whom they ask, the group that comes first, labels of groups, and what tells a widget definition
PAGE_LISTS = (("page_headers", "creator"), ("page_response_headers", "participant"), ("aggregate_level_questions", "aggregate"))
FIRST_GROUP = "inline_components"
GROUP_LABELS = {"global_price_components": "Event-level price components", "aggregate_components": "Aggregate columns", "header_components": "Header fields"}
DEFINES = ("input_type", "key_attribute", "configuration")
MOST_OPTIONS = 12

WIDGET = "struct<name:string,key:string,input_type:string,side:string,required:boolean,hidden:boolean,prefix:string,suffix:string,priority:double,options:array<string>,custom:boolean>"
GROUPS = f"array<struct<key:string,label:string,widgets:array<{WIDGET}>>>"


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _text(value: Column, *names: str) -> Column:
    """The first of the members that is a text and not empty."""
    return F.coalesce(*[F.nullif(_at(value, f"$.{n}", "string"), F.lit("")) for n in names])


def _is_object(value: Column) -> Column:
    return _at(value, "$", "map<string,variant>").isNotNull()


def _objects(value: Column) -> Column:
    """The objects of a list; none where the value is no list."""
    return F.filter(F.coalesce(_at(value, "$", "array<variant>"), F.array().cast("array<variant>")), _is_object)


def _settings(settings: Column) -> dict[str, Column]:
    """What a widget's settings tell of it."""
    asks = _at(settings, "$.field_type", "string")
    listed = _at(_at(settings, "$.cell_options"), "$", "array<variant>")
    options = F.slice(F.filter(F.transform(listed, lambda o: F.when(_is_object(o), _at(o, "$.value", "string")).otherwise(_at(o, "$", "string"))), lambda o: o.isNotNull()), 1, MOST_OPTIONS)
    return {
        "side": F.when(asks.isin("participant", "formula"), asks), "required": F.coalesce(_at(settings, "$.is_required", "boolean"), F.lit(False)),
        "hidden": F.coalesce(_at(settings, "$.mode_type", "string") == "hidden", F.lit(False)), "prefix": _text(settings, "prefix"), "suffix": _text(settings, "suffix"),
        "priority": _at(settings, "$.priority", "double"), "options": options,
    }


def widget(value: Column, fallback: Column, side: Column | None = None) -> Column:
    """A widget of the dashboard from its definition; its settings stand in `configuration` or `config`."""
    said = _settings(F.coalesce(F.when(_is_object(_at(value, "$.configuration")), _at(value, "$.configuration")), F.when(_is_object(_at(value, "$.config")), _at(value, "$.config"))))
    return F.struct(
        F.coalesce(_text(value, "name", "label"), fallback, _text(value, "key_attribute"), F.lit("(unnamed)")).alias("name"), _text(value, "key_attribute", "key").alias("key"), _text(value, "input_type").alias("input_type"),
        F.coalesce(*([side] if side is not None else []), said["side"], F.lit("creator")).alias("side"), *[said[n].alias(n) for n in ("required", "hidden", "prefix", "suffix")],
        F.coalesce(said["priority"], _at(value, "$.priority", "double")).alias("priority"), said["options"].alias("options"), F.coalesce(_at(value, "$.widget_type", "string") == "custom", F.lit(False)).alias("custom"),
    )


def _by_priority(widgets: Column) -> Column:
    """In order of priority, those without one last, and otherwise as they stood."""
    keyed = F.transform(widgets, lambda w, i: F.struct(F.coalesce(w["priority"], F.lit(1e9)).alias("p"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda x: x["w"])


def _pages(value: Column) -> Column:
    def page(p: Column, i: Column) -> Column:
        asked = F.concat(*[_asked(p, bucket, side) for bucket, side in PAGE_LISTS])
        name = F.coalesce(_text(p, "name"), F.concat(F.lit("Page "), i + 1))
        return F.struct(F.coalesce(_at(p, "$.order", "double"), (i + 1).cast("double")).alias("order"), i.alias("i"), F.struct(name.alias("key"), name.alias("label"), asked.alias("widgets")).alias("group"))

    return F.transform(F.array_sort(F.transform(_objects(value), page)), lambda x: x["group"])


def _asked(page: Column, bucket: str, side: str) -> Column:
    return F.transform(_objects(_at(page, f"$.{bucket}")), lambda q: widget(q, F.lit(None).cast("string"), F.lit(side)))


def layouts(templates: DataFrame, key: str = "id", column: str = "widgets") -> DataFrame:
    """(key, layout, groups) of each template; members keep the order that they have in the document."""
    text = F.col(column).cast("string")
    rows = templates.select(key, text.alias("doc"), F.try_parse_json(text).alias("v"))
    members = _at(F.col("v"), "$", "map<string,variant>")
    rows = rows.select(key, "v", members.alias("members"), F.when(members.isNotNull(), F.json_object_keys("doc")).alias("names"))
    words = lambda k: F.replace(k, F.lit("_"), F.lit(" "))
    label = F.create_map(*[F.lit(x) for kv in GROUP_LABELS.items() for x in kv])
    none = F.lit(None).cast("string")
    of = lambda k: F.try_element_at("members", k)
    lists = F.filter("names", lambda k: _at(of(k), "$", "array<variant>").isNotNull())
    named = F.transform(lists, lambda k, i: F.struct((k != FIRST_GROUP).alias("later"), i.alias("i"), F.struct(k.alias("key"), F.coalesce(F.try_element_at(label, k), words(k)).alias("label"), _by_priority(F.transform(_objects(of(k)), lambda w: widget(w, none))).alias("widgets")).alias("group")))
    sheet = F.transform(F.array_sort(F.filter(named, lambda g: F.size(g["group"]["widgets"]) > 0)), lambda g: g["group"])
    defined = F.filter("names", lambda k: _is_object(of(k)) & F.exists(F.map_keys(_at(of(k), "$", "map<string,variant>")), lambda m: m.isin(*DEFINES)))
    fields = F.array(F.struct(F.lit("fields").alias("key"), F.lit("Fields").alias("label"), _by_priority(F.transform(defined, lambda k: widget(of(k), words(k)))).alias("widgets")))
    kind = F.when(_at(F.col("v"), "$", "array<variant>").isNotNull(), "form").when(F.size(lists) > 0, "sheet").when(F.size(defined) > 0, "fields").otherwise("empty")
    rows = rows.withColumn("layout", kind)
    groups = F.when(F.col("layout") == "form", _pages(F.col("v")).cast(GROUPS)).when(F.col("layout") == "sheet", sheet.cast(GROUPS)).when(F.col("layout") == "fields", fields.cast(GROUPS)).otherwise(F.array().cast(GROUPS))
    return rows.select(key, "layout", groups.alias("groups"))


def template_layouts(templates: DataFrame, key: str = "id", column: str = "widgets") -> DataFrame:
    """(key, layout, groups, widgets) of each template, groups and widgets by name."""
    found = layouts(templates, key, column)
    return found.select(key, "layout", F.transform("groups", lambda g: g["key"]).alias("groups"), F.flatten(F.transform("groups", lambda g: F.transform(g["widgets"], lambda w: w["name"]))).alias("widgets"))


def widget_names(found: DataFrame, key: str = "id", most: int = 40) -> DataFrame:
    """(key, names) for a search card: what a template asks for, each name once; pages of a form are named too."""
    each = F.flatten(F.transform("groups", lambda g: F.concat(F.when(F.col("layout") == "form", F.array(g["key"])).otherwise(F.array().cast("array<string>")), F.transform(g["widgets"], lambda w: w["name"]))))
    return found.select(key, F.slice(F.array_distinct(F.transform(F.filter(each, lambda n: n != ""), lambda n: F.substring(n, 1, 80))), 1, most).alias("names"))


def with_mappings(found: DataFrame, mappings: DataFrame, key: str = "id") -> DataFrame:
    """(key, layout, groups, source): empty templates take the widgets mapped to them, as one group of a sheet.

    mappings: the key, position, name, key_attribute, input_type, custom, config (JSON). A mapping is read as a widget with
    its settings; they come by priority, then by position. Those of templates that aren't empty go before they are read.
    """
    wanted = found.filter("layout = 'empty'").select(F.col(key).alias("empty")).distinct()
    rows = mappings.join(wanted, F.col(key) == F.col("empty"), "left_semi").select("*", F.try_parse_json("config").alias("parsed"))
    rows = rows.select("*", F.when(_is_object(F.col("parsed")), F.col("parsed")).alias("settings"))
    text = lambda n: F.nullif(F.col(n).cast("string"), F.lit(""))
    said = _settings(F.col("settings"))
    both = F.struct(
        F.coalesce(text("name"), text("key_attribute"), F.lit("(unnamed)")).alias("name"), text("key_attribute").alias("key"), text("input_type").alias("input_type"), F.coalesce(said["side"], F.lit("creator")).alias("side"),
        *[said[n].alias(n) for n in ("required", "hidden", "prefix", "suffix", "priority", "options")], F.coalesce("custom", F.lit(False)).alias("custom"),
    )
    rows = rows.select(F.col(key).alias("m_key"), "position", both.alias("w"))
    sets = rows.groupBy("m_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("w.priority", F.lit(1e9)).alias("p"), "position", "w"))), lambda x: x["w"]).alias("mapped"))
    joined = found.join(sets, found[key] == sets["m_key"], "left")
    use = (F.col("layout") == "empty") & F.col("mapped").isNotNull()
    group = F.array(F.struct(F.lit(FIRST_GROUP).alias("key"), F.lit(FIRST_GROUP.replace("_", " ")).alias("label"), F.col("mapped").alias("widgets"))).cast(GROUPS)
    return joined.select(key, F.when(use, "sheet").otherwise(F.col("layout")).alias("layout"), F.when(use, group).otherwise(F.col("groups")).alias("groups"), F.when(use, "widget_mappings").otherwise("widgets_json").alias("source"))


def widget_rows(found: DataFrame, key: str = "id") -> DataFrame:
    """One row a widget: key, layout, further columns of the templates, grp (its place), title, nth, and the widget's members."""
    own = [key, "layout", *[c for c in found.columns if c not in (key, "layout", "groups")]]
    groups = found.select(*own, F.posexplode("groups").alias("grp", "g"))
    return groups.select(*own, "grp", F.col("g.label").alias("title"), F.posexplode("g.widgets").alias("nth", "w")).select(*own, "grp", "title", "nth", "w.*")
