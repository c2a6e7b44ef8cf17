"""Stored text: line reads, fixed-string search, passages, mentions, cards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..session import spread

#: fixed values: paths that are never read, and the sizes of reads and passages
SECRET_PATH = r"(^|/)(\.env|\.env\..*|.*\.pem|id_rsa.*|.*\.key|.*\.p12|.*\.jks)$"
LONGEST_READ = 120
PASSAGE_WORDS, SMALL_PASSAGE = 350, 40
SENT = 100_000  # the most mentions that every task gets
EMPHASIS = str.maketrans("", "", "*_`")


def lines(texts: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, line, content) with lines counted from 1."""
    return texts.select(*key, F.posexplode(F.split("text", "\n", -1)).alias("p", "content")).select(*key, (F.col("p") + 1).alias("line"), "content")


def read_lines(texts: DataFrame, start: int, end: int, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines start to end of each text, at most 120, with the total and whether more was asked for."""
    last = min(end, start + LONGEST_READ - 1)
    parts = F.split("text", "\n", -1)
    out = texts.select(*key, F.size(parts).alias("total_lines"), F.posexplode(F.slice(parts, F.lit(start), F.lit(last - start + 1))).alias("p", "content"))
    return out.select(*key, (F.col("p") + start).alias("line"), "content", "total_lines", (F.least(F.lit(end), F.col("total_lines")) > last).alias("truncated"))


def readable(paths: DataFrame, column: str = "path") -> DataFrame:
    return paths.filter(~F.col(column).rlike(SECRET_PATH))


def below(texts: DataFrame, *folders: str, column: str = "path") -> DataFrame:
    """Texts whose path lies below one of the folders and may be read; all that may be read if none is named."""
    out = readable(texts, column)
    if not folders:
        return out
    inside = F.lit(False)
    for f in folders:
        inside = inside | (F.col(column) == f.rstrip("/")) | F.col(column).startswith(f.rstrip("/") + "/")
    return out.filter(inside)


def grep(texts: DataFrame, pattern: str, key: str = "doc_id", max_files: int = 200, max_hits: int = 40, context: int = 2) -> DataFrame:
    """Lines that hold a fixed string of three letters and more, with their neighbours.

    Texts are filtered before they are cut into lines; files are taken in key order, hits in line
    order, up to the limits of a search report.
    """
    if len(pattern) < 3:
        raise ValueError("a pattern of three characters or more is required")
    files = texts.filter(F.col("text").contains(pattern)).orderBy(key).limit(max_files)
    parts = files.withColumn("parts", F.split("text", "\n", -1))
    hits = parts.select(key, "parts", F.posexplode("parts").alias("p", "content")).filter(F.col("content").contains(pattern))
    around = F.slice("parts", F.greatest(F.col("p") + 1 - context, F.lit(1)), F.least(F.col("p"), F.lit(context)) + 1 + context)
    out = hits.select(key, (F.col("p") + 1).alias("line"), F.substring(F.trim("content"), 1, 200).alias("content"), F.array_join(around, "\n").alias("context"))
    return out.orderBy(key, "line").limit(max_hits)


def passages(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, heading_path, text, words): passages scoped by heading, long sections cut at paragraphs.

    Headings inside fenced code are text. Pieces of fewer than 40 words join the one before under
    the same heading while both stay within 350 words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, *p) for k, t in zip(pdf[key], pdf.text, strict=True) for i, p in enumerate(cut_passages(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "heading_path", "text", "words"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, ordinal int, heading_path string, text string, words int")


def sections(text: str) -> Iterator[tuple[str, list[str]]]:
    """(heading path, paragraphs) of each section; a heading has one to four marks, and none stands between fences."""
    path, paragraphs, open_fence = [], [[]], False
    for line in text.split("\n"):
        bare = line.strip()
        if bare[:3] in ("```", "~~~"):
            open_fence = not open_fence
        depth = len(line) - len(line.lstrip("#"))
        title = line[depth:].strip().rstrip("#").strip().translate(EMPHASIS)
        if not open_fence and 1 <= depth <= 4 and line[depth : depth + 1].isspace() and title:
            yield " > ".join(path), ["\n".join(x) for x in paragraphs if x]
            path, paragraphs = path[: depth - 1] + [title], [[]]
        elif bare:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    yield " > ".join(path), ["\n".join(x) for x in paragraphs if x]


def cut_passages(text: str) -> list[tuple[str, str, int]]:
    """(heading path, text, words) of each passage: paragraphs of a section, as many as fit into PASSAGE_WORDS."""
    made: list[list] = []
    for path, paragraphs in sections(text):
        fresh = True  # a section starts a passage, but a small one joins its predecessor of the same path
        packed: list[list] = []
        for paragraph in paragraphs:
            n = len(paragraph.split())
            if fresh or packed[-1][2] + n > PASSAGE_WORDS:
                packed.append([path, paragraph, n])
            else:
                packed[-1][1] += "\n\n" + paragraph
                packed[-1][2] += n
            fresh = False
        for piece in packed:
            if made and piece[2] < SMALL_PASSAGE and made[-1][0] == path and made[-1][2] + piece[2] <= PASSAGE_WORDS:
                made[-1][1] += "\n\n" + piece[1]
                made[-1][2] += piece[2]
            else:
                made.append(piece)
    return [(path, body.strip(), n) for path, body, n in made if n]


#: What names look like: a namespace or two humps, a member behind one of these, or words joined by underscores.
CONSTANT = r"(?:[A-Z]\w*+(?:::[A-Z]\w*+)++|(?:[A-Z][a-z0-9]++){2,})(?!\w)"
MEMBER = r"[#.][a-z_]\w*+[?!]?"
NAMED = rf"(?<![\w:])({CONSTANT}(?:{MEMBER})?)"
SNAKE = r"(?<!\w)([a-z]++(?:_[a-z0-9]++)++)(?!\w)"


def mentions(texts: DataFrame, key: str = "doc_id", most: int = 80) -> DataFrame:
    """(key, name, n): identifiers a text names, the most frequent first, at most 80 of a text.

    Constants have two humps or a namespace, methods follow them after # or a point, and snake
    names have an underscore. A method names its constant too. Texts that bear no sign of any are passed over at once.
    """
    found = F.regexp_extract_all("text", F.lit(NAMED), F.lit(1))
    constants = F.transform(found, lambda x: F.concat(F.lit("const:"), F.regexp_extract(x, "^[^#.]+", 0)))
    methods = F.transform(F.filter(found, lambda x: x.rlike("[#.]")), lambda x: F.concat(F.lit("method:"), x))
    snakes = F.transform(F.regexp_extract_all("text", F.lit(SNAKE), F.lit(1)), lambda x: F.concat(F.lit("snake:"), x))
    per = texts.filter(F.col("text").rlike("[a-z0-9][A-Z]|::|_")).select(key, F.explode(F.concat(constants, methods, snakes)).alias("name")).groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "name")
    return per.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def link_mentions(named: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, n): mentions joined to the entities of their names.

    Few mentions are sent to the entities, which are dealt by id, so that neither a frequent name nor a large table fills a task.
    """
    bare = named.withColumn("name", F.regexp_replace("name", "^(const|method|snake):", "")).groupBy(key, "name").agg(F.sum("n").alias("n"))
    few = bare.limit(SENT + 1).count() <= SENT
    dealt = spread(entities.select("id", "name"), "id", entities.count(), 100_000)
    return dealt.join(F.broadcast(bare) if few else bare, "name").groupBy(key, "id").agg(F.sum("n").alias("n"))


def cards(entities: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, card, card_hash): a node's text for embedding, with the sorted names beside it (id, other)."""
    first = Window.partitionBy("id").orderBy("other")
    few = neighbours.select("id", "other").distinct().withColumn("k", F.row_number().over(first)).filter("k <= 12")
    beside = few.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("beside"))
    card = F.concat_ws(". ", F.concat_ws(" ", F.lower("kind"), "name"), X.humanize("name"), "path", "beside")
    return entities.join(beside, "id", "left").select("id", card.alias("card")).withColumn("card_hash", F.sha2("card", 256))


def stale_cards(fresh: DataFrame, embedded: DataFrame) -> DataFrame:
    """Cards without a vector for their text: all that is left to embed."""
    return fresh.join(embedded.select("card_hash").distinct(), "card_hash", "left_anti")


def known_paths_only(texts: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, path): file paths a text names that no known path ends with."""
    named = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?:[\w.-]+/)+[\w.-]+\.[a-z]{1,4})"), F.lit(1)))).alias("path"))
    base = F.element_at(F.split("path", "/"), -1)
    held = known.select(F.col("path").alias("known"), F.element_at(F.split("path", "/"), -1).alias("base")).distinct()
    hit = named.withColumn("base", base).join(held, "base").filter(F.col("known").endswith(F.col("path"))).select(key, "path")
    return named.join(hit, [key, "path"], "left_anti")
