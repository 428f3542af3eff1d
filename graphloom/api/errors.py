"""Errors that callers can tell apart, with their exit codes and RPC codes."""

from __future__ import annotations


class GraphError(Exception):
    code, exit_code, rpc_code = "internal_failure", 10, -32603

    def __init__(self, message: str, candidates: list[dict] | None = None):
        super().__init__(message)
        self.message, self.candidates = message, candidates or []


class InvalidArgument(GraphError):
    code, exit_code, rpc_code = "invalid_argument", 2, -32602


class RepositoryUnavailable(GraphError):
    code, exit_code, rpc_code = "repository_unavailable", 3, -32010


class IndexUnavailable(GraphError):
    code, exit_code, rpc_code = "index_unavailable", 4, -32011


class NotFound(GraphError):
    code, exit_code, rpc_code = "not_found", 5, -32012


class AmbiguousSymbol(GraphError):
    code, exit_code, rpc_code = "ambiguous_symbol", 6, -32013


class ExportFailure(GraphError):
    code, exit_code, rpc_code = "export_failure", 7, -32603


class PluginFailure(GraphError):
    code, exit_code, rpc_code = "plugin_failure", 10, -32014

    def __init__(self, message: str, operation_completed: bool = False):
        super().__init__(message)
        self.operation_completed = operation_completed
