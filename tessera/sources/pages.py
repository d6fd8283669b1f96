"""Script tags of HTML pages and signatures of their scripts: parsing needs Python, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tessera.functions.js_parser import JsSyntaxError
from tessera.functions.js_signature import DEFAULT_VERSION, modules, signature, tagged
from tessera.schemas import SIGNATURE
from tessera.sources.tables import dealt

#: Tasks that the copies of one script are dealt over, and bytes of scripts that are read at once.
COPIES, PIECE_BYTES = 16, 4 << 20


class _Scripts(HTMLParser):
    """Script elements of head and body, with attributes and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.where, self.open = [], "head", None

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.where = "body"
        elif tag == "script":
            self.open = (self.where, dict(attrs), [])
            self.found.append(self.open)
        elif tag not in ("html", "head", "meta", "title", "link", "style", "base", "noscript", "template"):
            self.where = "body"

    def handle_data(self, data):
        if self.open:
            self.open[2].append(data)

    def handle_endtag(self, tag):
        if tag == "script":
            self.open = None


def scripts_of(html: str | None) -> list[dict]:
    """Head scripts, then body scripts, numbered over both: {idx, location, src, content}."""
    parser = _Scripts()
    parser.feed(html or "")
    parser.close()
    ordered = [s for w in ("head", "body") for s in parser.found if s[0] == w]
    return [{"idx": i, "location": w, "src": a.get("src"), "content": None if "src" in a else "".join(t)} for i, (w, a, t) in enumerate(ordered)]


_SCRIPT = pa.list_(pa.struct([("idx", pa.int32()), ("location", pa.string()), ("src", pa.string()), ("content", pa.string())]))


def script_tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, idx, location, src, content) of every script element. Null pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = pa.array([scripts_of(h) for h in b.column(1).to_pylist()], _SCRIPT)
            yield pa.RecordBatch.from_arrays([b.column(0), found], [key, "scripts"])

    out = pages.select(key, html).mapInArrow(run, f"{key} {kind}, scripts array<struct<idx:int,location:string,src:string,content:string>>")
    return out.select(key, F.explode("scripts").alias("s")).select(key, "s.idx", "s.location", "s.src", "s.content")


def extract(sources: DataFrame, keys: list[str], code: str = "content", version: int = DEFAULT_VERSION, bundles: bool = False) -> DataFrame:
    """(keys, id, id_type, functions, literals, comments, error): a row for each script, or for each module of a bundle.

    A script that can't be read gives one row with the error: failures are set aside, they don't end the job. Scripts are
    dealt over all cores by their text, so that equal ones are mostly read once; a very common one goes to COPIES tasks.
    """
    schema = StructType([*(sources.schema[k] for k in keys), *SIGNATURE.fields, StructField("error", SIGNATURE["id"].dataType)])
    parsed = StructType(schema.fields[len(keys) :])
    arrow = to_arrow_schema(parsed)

    def read(src: str) -> list[dict]:
        try:
            found = modules(src, version) if bundles else [signature(src, version)]
        except JsSyntaxError as e:
            return [{"error": str(e)}]
        return [f | {"literals": tagged(f["literals"])} for f in found]

    def run(batches):
        known: dict[str, list[dict]] = {}
        for b in batches:
            for part in _pieces(b, len(keys)):
                texts = [t or "" for t in part.column(len(keys)).to_pylist()]
                known = {t: known[t] if t in known else read(t) for t in dict.fromkeys(texts)}
                starts, rows = {}, []
                for t, found in known.items():
                    starts[t] = len(rows)
                    rows += found
                each = pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)
                own = pa.array([i for i, t in enumerate(texts) for _ in known[t]], pa.int32())
                at = pa.array([starts[t] + k for t in texts for k in range(len(known[t]))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(own) for k in range(len(keys))), *(c.take(at) for c in each.columns)], names=schema.names)

    text = F.xxhash64(code)
    spread = dealt(sources.select(*keys, code), text, F.pmod(F.xxhash64(*keys), F.lit(COPIES)))
    return spread.sortWithinPartitions(text).mapInArrow(run, schema)


def _pieces(b: pa.RecordBatch, column: int):
    """Runs of rows with about PIECE_BYTES of a column's text."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < b.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, side="right")))
        yield b.slice(at, end - at)
        at = end
