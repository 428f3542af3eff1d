"""JSON-RPC server over a byte stream with Content-Length framing: a reader and one worker.

A request that is cancelled while it waits or runs gets a cancellation error; its Spark jobs are cancelled too.
"""

from __future__ import annotations

import json
import queue
import threading

from graphloom import __version__
from graphloom.api import errors

MAX_MESSAGE = 64 * 1024 * 1024
PARSE, INVALID, METHOD, PARAMS, INTERNAL, CANCELLED, NOT_INITIALIZED = -32700, -32600, -32601, -32602, -32603, -32800, -32001


def read_message(stream) -> bytes | None:
    """Body of the next message, None at the end; ValueError for bad framing."""
    length = None
    while True:
        line = stream.readline()
        if not line:
            return None
        line = line.strip()
        if not line:
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    if length is None or not 0 <= length <= MAX_MESSAGE:
        raise ValueError("missing or too large Content-Length")
    body = stream.read(length)
    if len(body) < length:
        return None
    return body


def write_message(stream, message: dict) -> None:
    body = json.dumps(message, ensure_ascii=False, separators=(",", ":")).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


def serve(client, source, sink) -> int:
    lock, work = threading.Lock(), queue.Queue()
    cancelled: set = set()
    waiting: set = set()
    state = {"initialized": False, "shutdown": False, "repository": None}
    sc = client.spark.sparkContext

    def reply(ident, result=None, error=None) -> None:
        with lock:
            write_message(sink, {"jsonrpc": "2.0", "id": ident, **({"error": error} if error else {"result": result})})

    def fail(ident, code: int, message: str, data=None) -> None:
        reply(ident, error={"code": code, "message": message, **({"data": data} if data else {})})

    def run(method: str, p: dict):
        if method == "initialize":
            state["initialized"], state["repository"] = True, p.get("repository") or p.get("rootPath")
            return {"server": {"name": "graphloom", "version": __version__}, "capabilities": {"methods": sorted(METHODS)}}
        repository = p.get("repository") or state["repository"]
        if not isinstance(repository, str):
            raise errors.InvalidArgument("repository is missing")
        return METHODS[method](client, repository, p)

    def worker() -> None:
        while (item := work.get()) is not None:
            ident, method, p = item
            try:
                if ident in cancelled:
                    raise InterruptedError
                sc.setJobGroup(f"rpc-{ident}", method, True)
                result = run(method, p)
                if ident in cancelled:
                    raise InterruptedError
                if ident is not None:
                    reply(ident, result)
            except errors.GraphError as e:
                fail(ident, e.rpc_code, e.message, {"code": e.code, "candidates": e.candidates})
            except (KeyError, TypeError) as e:
                fail(ident, PARAMS, f"invalid parameters: {e}")
            except Exception as e:
                fail(ident, CANCELLED if ident in cancelled else INTERNAL, "request cancelled" if ident in cancelled else str(e).split("\n")[0])
            finally:
                waiting.discard(ident)
                cancelled.discard(ident)

    thread = threading.Thread(target=worker, daemon=True)
    thread.start()
    status = 1
    while True:
        try:
            body = read_message(source)
        except ValueError as e:
            fail(None, PARSE, str(e))
            break
        if body is None:
            break
        try:
            m = json.loads(body)
        except ValueError:
            fail(None, PARSE, "parse error")
            continue
        if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str):
            fail(m.get("id") if isinstance(m, dict) else None, INVALID, "invalid request")
            continue
        method, ident, p = m["method"], m.get("id"), m.get("params") or {}
        if method == "exit":
            status = 0 if state["shutdown"] else 1
            break
        if method == "$/cancelRequest":
            if p.get("id") in waiting:
                cancelled.add(p["id"])
                sc.cancelJobGroup(f"rpc-{p['id']}")
        elif state["shutdown"]:
            fail(ident, INVALID, "server is shut down")
        elif method == "shutdown":
            state["shutdown"] = True
            reply(ident)
        elif method != "initialize" and method not in METHODS:
            fail(ident, METHOD, f"unknown method: {method}")
        elif method != "initialize" and not state["initialized"] and work.empty() and not waiting:
            fail(ident, NOT_INITIALIZED, "server is not initialized")
        elif not isinstance(p, dict):
            fail(ident, PARAMS, "params must be an object")
        else:
            waiting.add(ident)
            work.put((ident, method, p))
    work.put(None)
    thread.join()
    return status


def _status(client, repository: str, p: dict) -> dict:
    try:
        client._tables(repository)
    except errors.IndexUnavailable:
        return {"repository": repository, "indexed": False}
    return {"repository": repository, "indexed": True}


def _index(client, repository: str, p: dict) -> dict:
    r = client.index(repository)
    return {**r.counts, **r.timings_ms, "warnings": r.warnings}


METHODS = {
    "workspace.status": _status,
    "workspace.index": _index,
    "query.symbol": lambda c, r, p: c.symbol(r, p["symbol"], p.get("signature"), p.get("file")),
    "query.file": lambda c, r, p: c.file(r, p["path"]),
    "query.callers": lambda c, r, p: c.callers(r, p["symbol"], p.get("signature"), p.get("file")),
    "query.callees": lambda c, r, p: c.callees(r, p["symbol"], p.get("signature"), p.get("file")),
    "query.impact": lambda c, r, p: c.impact(r, p["target"], p.get("signature"), p.get("file")),
    "query.path": lambda c, r, p: c.path(r, p["source"], p["target"], p.get("source_signature"), p.get("source_file"), p.get("target_signature"), p.get("target_file")),
    "graph.get": lambda c, r, p: c.graph(r),
}
