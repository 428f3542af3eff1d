"""JSON and text forms of results. JSON is one line; keys come in a fixed order."""

from __future__ import annotations

import json
from typing import Any


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) + "\n"


def range_json(r: dict) -> dict:
    return {side: {"line": r[f"{side}_line"], "column": r[f"{side}_column"], "byte": r[f"{side}_byte"]} for side in ("start", "end")}


def symbol_json(s: dict) -> dict:
    return {"kind": s["kind"], "name": s["name"], "qualified_name": s["qualified_name"], "signature": s["signature"], "file": s["path"], "range": range_json(s["range"])}


def result_json(query: str, body: dict) -> dict:
    return {"schema_version": 1, "ok": True, "query": query, **body}


def error_json(code: str, message: str, candidates: list[dict]) -> dict:
    return {"schema_version": 1, "ok": False, "error": {"code": code, "message": message, "candidates": candidates}}


def _at(evidence: dict, path: str) -> str:
    return f"{path}:{evidence['start']['line']}:{evidence['start']['column']}"


def _name(symbol: dict | None) -> str:
    return symbol["qualified_name"] if symbol else "<unresolved>"


def text(query: str, body: dict) -> str:
    """The same result for people."""
    out: list[str] = []

    def listed(title: str, rows: list[str]) -> None:
        out.append(f"{title}:")
        out.extend(f"  {r}" for r in rows or ["None"])

    if query == "symbol":
        s = body["symbol"]
        out += [f"Symbol: {s['qualified_name']}", f"Kind: {s['kind']}", f"Signature: {s['signature'] or 'None'}", f"File: {_at(s['range'], s['file'])}"]
        out += [f"{side.capitalize()}: {', '.join(f'{n} {k}' for k, n in body[side].items())}" for side in ("callers", "callees")]
    elif query == "file":
        out.append(f"File: {body['path']}")
        listed("Definitions", [f"{d['qualified_name']} ({d['kind']}) {_at(d['range'], d['file'])}" for d in body["definitions"]])
        for side in ("incoming", "outgoing"):
            listed(f"{side.capitalize()} includes", [f"{i['source']} -> {i['target'] or i['target_text']} [{i['resolution']}, {i['confidence']}]" for i in body[f"{side}_includes"]])
    elif query in ("callers", "callees"):
        out.append(f"Symbol: {body['symbol']['qualified_name']}")
        listed(query.capitalize(), [f"{_name(c['caller'])} -> {_name(c['callee']) if c['callee'] else c['target_text']} [{c['resolution']}, {c['confidence']}]" for c in body["calls"]])
    elif query == "impact":
        listed("Confirmed", [f"{(r['node']['symbol'] or {}).get('qualified_name') or r['node']['file']} (depth {r['depth']}, {r['relationship']})" for r in body["confirmed"]])
        listed("Possible", [f"{(r['node']['symbol'] or {}).get('qualified_name') or r['node']['file']} (depth {r['depth']}, {r['relationship']})" for r in body["possible"]])
    elif query == "path":
        n = len(body["steps"])
        out.append(f"Path: {body['status']} ({n} {'step' if n == 1 else 'steps'})")
        out += [f"  {_name(s['source'])} -> {_name(s['target'])} [{s['resolution']}, {s['confidence']}]" for s in body["steps"]]
    return "\n".join(out) + "\n"
