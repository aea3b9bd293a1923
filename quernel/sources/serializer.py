"""Index settings as JSON, for storage, and as lines of text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from ..functions.analysis import Pipeline, runner
from ..operators.index import FieldConfig, Index


def _pipeline(p: Pipeline | None) -> dict | None:
    return None if p is None else {"runners": p.names, "separator": p.separator}


def _read_pipeline(d: dict | None) -> Pipeline | None:
    return None if d is None else Pipeline([runner(n) for n in d["runners"]], d["separator"])


def to_json(index: Index) -> str:
    """Everything but the data; runners by their names."""
    fields = {n: {"pipeline": _pipeline(c.pipeline), "query_pipeline": _pipeline(c.query_pipeline), "store_documents": c.store_documents, "store_positions": c.store_positions} for n, c in index.fields.items()}
    return json.dumps({"name": index.name, "ref": index.ref, "pipeline": _pipeline(index.pipeline), "fields": fields}, ensure_ascii=False)


def from_json(text: str) -> Index:
    d = json.loads(text)
    fields = {n: FieldConfig(_read_pipeline(f["pipeline"]), _read_pipeline(f["query_pipeline"]), f["store_documents"], f["store_positions"]) for n, f in d["fields"].items()}
    return Index(d["name"], d["ref"], _read_pipeline(d["pipeline"]), fields)


def _escaped(text: str) -> str:
    return re.sub(r"[#:|,%\n]", lambda m: f"%{ord(m.group()):02X}", text)


def _plain(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), text)


def _line(kind: str, **values: object) -> str:
    flat = {k: str(v).lower() if isinstance(v, bool) else ",".join(map(_escaped, v)) if isinstance(v, list) else _escaped(str(v)) for k, v in values.items()}
    return f"{kind}#" + "|".join(f"{k}:{v}" for k, v in flat.items())


def to_lines(index: Index) -> list[str]:
    """A line of settings, one of the store, and one a field in the order of names; special characters are percent-encoded."""
    out = [_line("settings", name=index.name, ref=index.ref, pipeline=index.pipeline.names), _line("db", name=f"index_{index.name}", options=["postings", "field_docs"])]
    return out + [_line("field", name=n, pipeline=c.pipeline.names, store_documents=c.store_documents, store_positions=c.store_positions) for n, c in sorted(index.fields.items())]


def from_lines(lines: Iterable[str]) -> Index:
    """The index of ``to_lines``, with no data; unknown kinds of lines are skipped."""
    index: Index | None = None
    for line in lines:
        kind, _, rest = line.rstrip("\n").partition("#")
        values = dict(part.partition(":")[::2] for part in rest.split("|"))
        names = [_plain(x) for x in values.get("pipeline", "").split(",") if x]
        if kind == "settings":
            index = Index(_plain(values["name"]), _plain(values["ref"]), Pipeline([runner(n) for n in names]), {})
        elif kind == "field" and index is not None:
            flags = {k: values.get(k) == "true" for k in ("store_documents", "store_positions")}
            index = index.add_field(_plain(values["name"]), pipeline=Pipeline([runner(n) for n in names]), **flags)
    if index is None:
        raise ValueError("there is no settings line")
    return index
