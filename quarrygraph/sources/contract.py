"""The contract of extractors: facts of a blob by name and version, found once, and read by other extractors of the same blob.

An extractor is a Python function over one blob's text; Spark brings each blob's text together with the facts that
the extractor needs as one partition of an Arrow table function. What is stored counts for the name and version it
was found with, so a new version is run again and nothing else is. A blob that fails leaves a status row with the
reason; one without facts leaves a status row as well, so neither is tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

FACTS = "blob string, extractor string, version string, kind string, name string, line int, value string"
NAMES = ["blob", "extractor", "version", "kind", "name", "line", "value"]
STATUS, OK, FAILED = "status", "ok", "failed"


@dataclass(frozen=True)
class Extractor:
    """`run(path, text, facts)` gives (kind, name, line, value); facts are (extractor, kind, name, line, value) of those it needs, by line."""

    name: str
    version: str
    run: Callable[[str, str, list[tuple]], Iterable[tuple]]
    path: str = "."
    needs: Sequence[str] = ()


def ordered(extractors: Sequence[Extractor]) -> list[Extractor]:
    """The extractors so that each comes after those it needs; ValueError if some need one another or one that isn't there."""
    left, out = list(extractors), []
    while left:
        ready = [e for e in left if set(e.needs) <= {x.name for x in out}]
        if not ready:
            raise ValueError(f"extractors need what is not there: {', '.join(e.name for e in left)}")
        out += ready
        left = [e for e in left if e not in ready]
    return out


def _function(extractor: Extractor):
    """The table function that runs an extractor over the rows of one blob: its text, and facts to read."""

    @F.arrow_udtf(returnType=FACTS)
    class Run:
        def __init__(self):
            self.rows = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.rows += rows.to_pylist()
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            out = []
            facts = sorted(((r["extractor"], r["kind"], r["name"], r["line"], r["value"]) for r in self.rows if r["extractor"] is not None), key=lambda f: (f[3] or 0, repr(f)))
            for r in self.rows:
                if r["extractor"] is None:
                    try:
                        found = [(*f, None, None, None)[:4] for f in extractor.run(r["path"], r["text"], facts)]
                        found.append((STATUS, OK, None, None))
                    except Exception as e:  # kept as the blob's status
                        found = [(STATUS, FAILED, None, f"{type(e).__name__}: {e}"[:500])]
                    out += [(r["blob"], extractor.name, extractor.version, *f) for f in found]
            if out:
                kinds = [pa.string()] * 5 + [pa.int32(), pa.string()]
                yield pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=NAMES)

    return Run


def extract(tree: DataFrame, texts: DataFrame, held: DataFrame, extractors: Sequence[Extractor]) -> DataFrame:
    """The facts held and those of the blobs that some extractor has not seen in its version.

    tree: path, blob; texts: blob, text; held: FACTS rows. Of a blob's paths the least one is told to the extractor.
    """
    for e in ordered(extractors):
        wanted = tree.filter(F.col("path").rlike(e.path)).groupBy("blob").agg(F.min("path").alias("path"))
        seen = held.filter((F.col("extractor") == e.name) & (F.col("version") == e.version)).select("blob").distinct()
        none = [F.lit(None).cast(t).alias(n) for n, t in (("extractor", "string"), ("kind", "string"), ("name", "string"), ("line", "int"), ("value", "string"))]
        missing = wanted.join(seen, "blob", "left_anti").join(texts, "blob").select("blob", "path", "text", *none)
        rows = missing
        if e.needs:
            versions = {x.name: x.version for x in extractors}
            own = [(F.col("extractor") == n) & (F.col("version") == versions[n]) for n in e.needs]
            read = own[0]
            for condition in own[1:]:
                read = read | condition
            facts = held.filter(read & (F.col("kind") != STATUS)).join(missing.select("blob"), "blob", "left_semi")
            rows = missing.union(facts.select("blob", F.lit(None).cast("string"), F.lit(None).cast("string"), "extractor", "kind", "name", "line", "value"))
        held = cut(held.select(*NAMES).union(_function(e)(rows.asTable().partitionBy("blob")).select(*NAMES)))
    return held


def failures(facts: DataFrame) -> DataFrame:
    """(blob, extractor, version, reason) of the blobs that could not be read."""
    return facts.filter((F.col("kind") == STATUS) & (F.col("name") == FAILED)).select("blob", "extractor", "version", F.col("value").alias("reason"))
