"""The readers as one cascade over documents of any kind, in one pass: an Arrow table function parses each document once.

Of the ways to read a document the first that finds something counts: JSON, a portal's XML, calendars, feeds, JSON-LD, and at last text for
a model to read (a boundary: it gives one row, without fields but with what the document says). Text of PDF and images comes with the landed document, as
whoever lands it has the tools for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenceloom.sources import landing

LEAST_TEXT = 100
SHAPE = f"{landing.SCHEMA}, tier int, said string"


def tiers(now: str) -> list[tuple[str, Callable[[str], bool], Callable[[str, str], list[dict]]]]:
    """Method, whether a body may be of its kind, and its reader, in their order."""
    portal = landing.portal_reader(now)
    xml = ("<?xml", "<rss", "<feed", "<rdf:RDF", "<events")
    return [
        ("json_api", lambda b: b.startswith(("[", "{")), landing._json_records),
        ("portal_xml", lambda b: b.startswith(xml), portal),
        ("ics", lambda b: "BEGIN:VCALENDAR" in b, landing._calendar_entries),
        ("rss", lambda b: b.startswith(xml), landing._rss_records),
        ("jsonld", lambda b: "ld+json" in b, landing._jsonld_events),
    ]


def _cascade(now: str):
    class Cascade:
        def __init__(self):
            self.tiers = tiers(now)

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            out: list[tuple] = []
            for doc, body, url, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "url", "text")), strict=True):
                out += [(doc, *x) for x in self.first(body or "", url or "", text)]
            columns = [pa.array([r[0] for r in out], pa.int64())]
            columns += [pa.array([r[3].get(f) for r in out], t) for f, t in zip(landing.FIELDS, landing._TYPES, strict=True)]
            columns += [pa.array([r[2] for r in out], pa.string()), pa.array([landing.CONFIDENCE[r[2]] if r[2] != "text" else None for r in out], pa.float64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[4] for r in out], pa.string())]
            yield pa.Table.from_arrays(columns, names=["doc_id", *landing.FIELDS, "method", "confidence", "tier", "said"])

        def first(self, body: str, url: str, text: str | None) -> list[tuple]:
            start = body.lstrip()
            for tier, (method, fits, reader) in enumerate(self.tiers):
                if fits(start) and (found := reader(body, url)):
                    return [(tier, method, r, None) for r in found]
            said = text or (landing.plain_text(body) if start.startswith("<") else " ".join(body.split()))
            # pages of under a hundred characters are shells that say nothing
            return [(len(self.tiers), "text", {}, said)] if len(said.strip()) >= LEAST_TEXT else []

    return F.arrow_udtf(Cascade, returnType=SHAPE)


def records(docs: DataFrame, now: str) -> DataFrame:
    """doc_id, fields, method, confidence, tier and, of the last tier, what the document says. docs: doc_id, body, url, and text where it was landed."""
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    return _cascade(now)(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "body", "url", text.alias("text")).asTable())
