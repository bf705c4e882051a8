"""Portable bioinformatics format: an Avro container (deflate) of metadata, a data dictionary and a row a patient.

Avro's binary form is small, so it is written here: rows are encoded where they are, in Arrow batches, and each partition gives finished
container blocks; the file is the header and then the blocks.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from strandline.functions.observations import field_name
from strandline.sources.scratch import folder

MARKER = bytes(range(16))
NULLABLE = ["null", "string"]
LIST = {"type": "array", "items": NULLABLE}


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _text(s: str) -> bytes:
    raw = s.encode()
    return _long(len(raw)) + raw


def _nullable(s: str | None) -> bytes:
    return _long(0) if s is None else _long(1) + _text(s)


def _array(items: list[bytes]) -> bytes:
    return (_long(len(items)) + b"".join(items) if items else b"") + _long(0)


def schema(fields: list[str], query_id: str) -> dict:
    patients, words = field_name("export-patients-" + query_id), field_name("export-data-dictionary-" + query_id)
    link = {"type": "record", "name": "Link", "fields": [{"name": "dst", "type": "string"}, {"name": "multiplicity", "type": {"type": "enum", "name": "Multiplicity", "symbols": [f"{a}_TO_{b}" for a in ("ONE", "MANY") for b in ("ONE", "MANY")]}}]}
    values = {"type": "map", "values": NULLABLE}
    prop = {"type": "record", "name": "Property", "fields": [{"name": "name", "type": "string"}, {"name": "ontology_reference", "type": "string"}, {"name": "values", "type": values}]}
    node = {"type": "record", "name": "nodes", "fields": [{"name": "name", "type": "string"}, {"name": "ontology_reference", "type": NULLABLE}, {"name": "links", "type": {"type": "array", "items": link}}, {"name": "properties", "type": {"type": "array", "items": prop}}, {"name": "values", "type": values}]}
    meta = {"type": "record", "name": "metadata", "fields": [{"name": "misc", "type": "string"}, {"name": "nodes", "type": {"type": "array", "items": node}}]}
    person = {"type": "record", "name": patients, "fields": [{"name": field_name(f), "type": NULLABLE if f == "patient_id" else LIST} for f in fields]}
    word = {"type": "record", "name": words, "fields": [{"name": "concept_path", "type": "string"}, {"name": "drs_uri", "type": LIST}, *({"name": n, "type": NULLABLE} for n in ("display", "dataset", "description"))]}
    relation = {"type": "record", "name": "Relation", "fields": [{"name": "dst_name", "type": "string"}, {"name": "dst_id", "type": "string"}]}
    return {"type": "record", "name": "entity", "fields": [{"name": "object", "type": [meta, person, word]}, {"name": "id", "type": NULLABLE}, {"name": "name", "type": "string"}, {"name": "relations", "type": {"type": "array", "items": relation}}]}


def _entity(kind: int, body: bytes, ident: str | None, name: str) -> bytes:
    return _long(kind) + body + _nullable(ident) + _text(name) + _array([])


def _block(rows: list[bytes]) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = squeeze.compress(b"".join(rows)) + squeeze.flush()
    return _long(len(rows)) + _long(len(data)) + data + MARKER


def head(fields: list[str], query_id: str, details: dict[str, dict] | None = None) -> bytes:
    """The container's header, the metadata entity and the dictionary's entities (one for each field but the id)."""
    s = schema(fields, query_id)
    _, person, word = (x["name"] for x in s["fields"][0]["type"])
    meta = {"avro.schema": json.dumps(s).encode(), "avro.codec": b"deflate"}
    pairs = _long(len(meta)) + b"".join(_text(k) + _long(len(v)) + v for k, v in meta.items()) + _long(0)
    prop = lambda f: _text(field_name(f)) + _text("") + _long(0)
    nodes = [_text(n) + _nullable("") + _array([]) + _array([prop(f) for f in own]) + _long(0) for n, own in ((person, fields), (word, ["concept_path", "drs_uri", "display", "dataset", "description"]))]
    rows = [_entity(0, _text("") + _array(nodes), None, "metadata")]
    for f in fields:
        if f == "patient_id":
            continue
        d = (details or {}).get(f) or {}
        body = _text(field_name(f)) + _array([_nullable(u) for u in d.get("drs_uri") or ()]) + b"".join(_nullable(d.get(k)) for k in ("display", "dataset", "description"))
        rows.append(_entity(2, body, field_name(f), word))
    return b"Obj\x01" + pairs + MARKER + _block(rows)


def blocks(rows: DataFrame, query_id: str) -> DataFrame:
    """(block binary) of a multi-value export: patient_id and array<string> columns."""
    name = schema(list(rows.columns), query_id)["fields"][0]["type"][1]["name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            people = []
            for ident, *cells in zip(*(c.to_pylist() for c in b.columns)):
                body = _nullable(None if ident is None else str(ident)) + b"".join(_array([_nullable(v) for v in x or ()]) for x in cells)
                people.append(_entity(1, body, None if ident is None else str(ident), name))
            if people:
                yield pa.record_batch([pa.array([_block(people)], pa.binary())], names=["block"])

    return rows.mapInArrow(run, "block binary")


def _open(path: str, mode: str):
    fs, inner = pafs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pafs.LocalFileSystem(), path)
    return fs.open_output_stream(inner) if mode == "w" else fs.open_input_stream(inner)


def write(rows: DataFrame, query_id: str, out: io.IOBase | str, details: dict[str, dict] | None = None) -> None:
    """Write one file. Tasks write their blocks to files of their own in the shared folder; the driver only appends these bytes, a few MB at a time, to the header."""
    fields = [field_name(c) for c in rows.columns]
    if len(set(fields)) < len(fields):
        raise ValueError("two columns have the same field name")
    parts = folder(rows.sparkSession, "pfb")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = f"{parts}/{uuid.uuid4().hex}"
            fs, inner = pafs.FileSystem.from_uri(name)
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(inner) as f:
                for block in b.column(0).to_pylist():
                    f.write(block)
            yield pa.record_batch([pa.array([name])], names=["file"])

    files = [r["file"] for r in blocks(rows, query_id).mapInArrow(store, "file string").collect()]  # names only; what a repeated task leaves isn't among them
    with _open(out, "w") if isinstance(out, str) else nullcontext(out) as f:
        f.write(head(list(rows.columns), query_id, details))
        for name in files:
            with _open(name, "r") as part:
                while chunk := part.read(8 << 20):
                    f.write(chunk)


def read(raw: bytes) -> tuple[dict, list[dict]]:
    """(schema, entities) of a container: a small reader for any schema of the types used here."""
    f = io.BytesIO(raw)

    def number() -> int:
        n, shift = 0, 0
        while True:
            b = f.read(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def value(t):
        if isinstance(t, list):
            return value(t[number()])
        if isinstance(t, str) and t in named:
            t = named[t]
        kind = t if isinstance(t, str) else t["type"]
        if kind == "null":
            return None
        if kind in ("string", "bytes"):
            data = f.read(number())
            return data.decode() if kind == "string" else data
        if kind == "enum":
            return t["symbols"][number()]
        if kind == "record":
            named[t["name"]] = t
            return {x["name"]: value(x["type"]) for x in t["fields"]}
        out = [] if kind == "array" else {}
        while n := number():
            for _ in range(abs(n)):
                if kind == "array":
                    out.append(value(t["items"]))
                else:
                    key = value("string")
                    out[key] = value(t["values"])
        return out

    named: dict[str, dict] = {}
    if f.read(4) != b"Obj\x01":
        raise ValueError("not an Avro container")
    meta = value({"type": "map", "values": "bytes"})
    s, marker, rows = json.loads(meta["avro.schema"]), f.read(16), []
    whole = f
    while whole.tell() < len(raw):
        f = whole
        n, size = number(), number()
        f = io.BytesIO(zlib.decompress(whole.read(size), -15))
        rows += [value(s) for _ in range(n)]
        if whole.read(16) != marker:
            raise ValueError("a block doesn't end in the marker")
    return s, rows
