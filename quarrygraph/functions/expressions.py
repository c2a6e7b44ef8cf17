"""Column expressions: similarity, vectors, URL paths, words, JSON. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: question words that never select content
STOP_WORDS = (
    "what which where when does do did the and for with from this that these those into onto have has had are is was were be been "
    "being can could should would will shall how why who whom whose there their they them then than also only just about above after again against all any "
    "both each few more most other some such over under very out off up down not nor but own same too tell show give explain please want need like know"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trigrams(text: Column | str) -> Column:
    """Distinct three-letter windows of each alphanumeric word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def endpoint_path(url: Column | str) -> Column:
    """The path family of a URL or route: no query, fragment, format, host or trailing slash; named parameters as *."""
    p = F.regexp_replace(_col(url), r"[?#].*$", "")
    p = F.regexp_replace(p, r"\(\.:format\)", "")
    p = F.regexp_replace(p, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    p = F.regexp_replace(p, r":[A-Za-z_][A-Za-z0-9_]*", "*")
    p = F.regexp_replace(F.concat(F.lit("/"), p), r"/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", ""))


def identifier_keys(question: Column | str) -> Column:
    """Snake-case keys of a question, lower case, in order of first mention."""
    found = F.regexp_extract_all(_col(question), F.lit(r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def content_words(question: Column | str) -> Column:
    """Words of four letters and more that aren't question words, in order of first mention."""
    found = F.regexp_extract_all(F.lower(_col(question)), F.lit(r"([a-z][a-z0-9]{3,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def stem(word: Column | str) -> Column:
    """A light English stem: common endings go, a doubled consonant before them as well."""
    w = F.regexp_replace(_col(word), r"(?:ing|edly|ed|ies|es|s|ly)$", "")
    return F.when(F.length(w) >= 3, F.regexp_replace(w, r"([bdgklmnprt])\1$", "$1")).otherwise(_col(word))


def tokens(text: Column | str) -> Column:
    """Distinct stemmed words of a text for word search."""
    words = F.filter(F.split(F.lower(_col(text)), "[^a-z0-9_]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(words, stem))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def underscore(name: Column | str) -> Column:
    """CamelCase and namespaces as lower snake case."""
    n = F.regexp_replace(_col(name), "::", "/")
    n = F.regexp_replace(n, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(n, r"([a-z0-9])([A-Z])", "$1_$2"))


def humanize(name: Column | str) -> Column:
    """An identifier as words."""
    n = F.regexp_replace(_col(name), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(n, r"[_./#:>-]+", " ")))


def html_text(html: Column | str) -> Column:
    """Visible text of a page: scripts, styles and comments gone, tags as blanks, entities decoded."""
    t = F.regexp_replace(_col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mask_personal(text: Column | str) -> Column:
    """Mail addresses and telephone numbers replaced by their kind."""
    t = F.regexp_replace(_col(text), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(t, r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[phone]")


def secret_tokens(text: Column | str) -> Column:
    """Tokens of 32 characters and more that hold three digits and a letter: likely credentials."""
    found = F.regexp_extract_all(_col(text), F.lit(r"([A-Za-z0-9_+/=-]{32,})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 3) & t.rlike("[A-Za-z]"))


def hashed_vector(text: Column | str, width: int = 64) -> Column:
    """A text as counts of its words by hash: a stand-in where no text embedder is at hand."""
    slot = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"), F.lit(width))
    slots = F.transform(F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda w: w != ""), slot)
    # words are hashed once: a name within a lambda holds the slots, which would else be worked out again for each of them
    count = lambda held, i: (F.size(held) - F.size(F.array_remove(held, i))).cast("float")
    return F.element_at(F.transform(F.array(slots), lambda held: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: count(held, i))), 1)


def json_contains(doc: Column | str, wanted) -> Column:
    """Whether a JSON text holds `wanted`: objects hold the members asked for, arrays some element for each asked for, scalars are equal."""
    return _contains(F.try_parse_json(_col(doc)), wanted)


def _contains(value: Column, wanted) -> Column:
    if isinstance(wanted, dict):
        parts = [_contains(F.try_variant_get(value, f"$['{k}']", "variant"), v) for k, v in wanted.items()]
        return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) & _all(parts)
    if isinstance(wanted, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        held = lambda w: F.coalesce(F.exists(items, lambda x: _contains(x, w)), F.lit(False))
        return items.isNotNull() & _all([held(w) for w in wanted])
    if wanted is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    kind = "boolean" if isinstance(wanted, bool) else "double" if isinstance(wanted, (int, float)) else "string"
    same = F.try_variant_get(value, "$", kind) == F.lit(float(wanted) if kind == "double" else wanted)
    named = {"boolean": "BOOLEAN", "double": "BIGINT|DECIMAL|DOUBLE|FLOAT|INT", "string": "STRING"}[kind]
    return F.coalesce(same & F.schema_of_variant(value).rlike(f"^(?:{named})"), F.lit(False))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def json_has_key(doc: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_col(doc)), key), F.lit(False))


def json_merge(base: Column | str, over: Column | str) -> Column:
    """A JSON object with the members of another laid over its own; members are replaced whole. Null if either isn't an object."""
    a, b = (F.from_json(_col(x), "map<string, variant>", {"mode": "PERMISSIVE"}) for x in (base, over))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.when(F.trim(_col(base)).startswith("{") & F.trim(_col(over)).startswith("{"), F.to_json(F.map_concat(kept, b)))
